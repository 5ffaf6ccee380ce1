"""Arrays, JSON and vectors as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vector_text(c: Column) -> Column:
    """``[a,b]`` of a vector."""
    return F.to_json(c)


def vector_of(c: Column) -> Column:
    return F.from_json(c, "array<float>")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors of one length, summed in double; 0 if one is all zero, null if lengths differ."""
    zero = F.lit(0.0)
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), zero, lambda s, x: s + x)
    na = F.aggregate(F.transform(a, lambda x: x.cast("double") * x.cast("double")), zero, lambda s, x: s + x)
    nb = F.aggregate(F.transform(b, lambda x: x.cast("double") * x.cast("double")), zero, lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), F.when((na == 0) | (nb == 0), zero).otherwise(dot / (F.sqrt(na) * F.sqrt(nb))))


def json_string(payload: Column, path: str) -> Column:
    """A non-empty string of a JSON object, else null."""
    return F.nullif(F.get_json_object(payload, path), F.lit(""))


def addresses(recipients: Column) -> Column:
    """Mail addresses of ``array<struct<emailAddress struct<name, address>>>``, empty ones left out."""
    return F.filter(F.transform(F.coalesce(recipients, F.array()), lambda r: r["emailAddress"]["address"]), lambda x: x.isNotNull() & (x != ""))


def all_strings(payload: Column) -> Column:
    """Whether a JSON text is an array of strings only."""
    items = F.from_json(payload, "array<variant>")
    return F.coalesce(F.forall(items, lambda v: F.schema_of_variant(v) == "STRING"), F.lit(False))


def valid_label(payload: Column) -> Column:
    """``{label, keywords}`` of a labelling answer, null if it breaks a bound: a label of 1 to 200
    characters (cut to 80), at most eight keywords, none empty."""
    s = F.from_json(payload, "label string, topicKeywords array<string>")
    ok = F.length(s["label"]).between(1, 200) & (F.size(s["topicKeywords"]) <= 8) & F.forall(s["topicKeywords"], lambda k: F.length(k) > 0)
    return F.when(ok, F.struct(F.substring(s["label"], 1, 80).alias("label"), s["topicKeywords"].alias("keywords")))


def valid_entities(text: Column, entities: Column) -> Column:
    """Whether all ``{type, offset, length}`` lie inside the text and have a known type."""
    return F.forall(entities, lambda e: e["type"].isin("email", "phone", "sin", "cc", "ip", "address", "person") & (e["offset"] >= 0) & (e["length"] >= 0) & (e["offset"] + e["length"] <= F.length(text)))


def callback(data: Column) -> Column:
    """``{question_index, choice}`` of ``cnfm:<n>:<y|a|s>`` with n from 1; null for anything else."""
    n = F.regexp_extract(data, r"^cnfm:(\d+):([yas])$", 1).try_cast("int")
    c = F.regexp_extract(data, r"^cnfm:(\d+):([yas])$", 2)
    choice = F.when(c == "y", "yes").when(c == "a", "anon").when(c == "s", "skip")
    return F.when(n >= 1, F.struct(n.alias("question_index"), choice.alias("choice")))


def first_alphabetical(gaps: Column, n: int = 2) -> Column:
    """At most ``n`` of them: all in their order, or the first ``n`` by name."""
    return F.when(F.size(gaps) > n, F.slice(F.array_sort(gaps), 1, n)).otherwise(gaps)


def greedy_fill(segments: Column, budget: int) -> Column:
    """``{kept, used, omitted}``: segments in order as long as they fit; one that does not is skipped and
    later, smaller ones are still tried."""
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("used"), F.lit(0).alias("omitted"))

    def step(s: Column, x: Column) -> Column:
        fits = s["used"] + F.length(x) <= budget
        return F.struct(
            F.when(fits, F.concat(s["kept"], F.array(x))).otherwise(s["kept"]).alias("kept"),
            (s["used"] + F.when(fits, F.length(x)).otherwise(0)).cast("int").alias("used"),
            (s["omitted"] + F.when(fits, 0).otherwise(1)).cast("int").alias("omitted"),
        )

    clean = F.filter(F.transform(segments, lambda x: F.trim(x)), lambda x: x != "")
    return F.aggregate(clean, start, step)


def typed_object(payload: Column, fields: dict[str, str | list[str]]) -> Column:
    """A JSON object as a struct, null if it is no object or any field is not what it must be.

    ``fields`` names each field's type: ``string``, ``text`` (a string that is not empty), ``boolean``, ``strings`` (an
    array of strings only), or a list of the strings allowed. Other fields of the object do not matter.
    """
    v = F.try_parse_json(payload)

    def typed(name: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))

    checks, values = [F.json_object_keys(payload).isNotNull()], []
    for name, kind in fields.items():
        if kind == "boolean":
            checks.append(typed(name) == "BOOLEAN")
            values.append(F.try_variant_get(v, f"$.{name}", "boolean").alias(name))
        elif kind == "strings":
            items = F.try_variant_get(v, f"$.{name}", "array<variant>")
            checks.append(typed(name).startswith("ARRAY") & F.forall(items, lambda x: F.schema_of_variant(x) == "STRING"))
            values.append(F.transform(items, lambda x: F.try_variant_get(x, "$", "string")).alias(name))
        else:
            value = F.try_variant_get(v, f"$.{name}", "string")
            checks.append(typed(name) == "STRING")
            if isinstance(kind, list):
                checks.append(value.isin(kind))
            elif kind == "text":
                checks.append(value != "")
            values.append(value.alias(name))
    ok = checks[0]
    for c in checks[1:]:
        ok = ok & F.coalesce(c, F.lit(False))
    return F.when(ok, F.struct(*values))


def reply_record(kind: Column, choice: Column, text: Column, transcript: Column, audio_url: Column) -> Column:
    """What a reply is: ``{response, text, transcript, audio_url, confirms, needs_text}``.

    A pressed button is its choice, and confirms unless it skips. A voice message is its transcript; without one the
    reply is not taken and a text is asked for. All else is text. Neither of the two confirms.
    """
    none = F.lit(None).cast("string")
    pressed, spoken = F.coalesce((kind == "callback") & choice.isNotNull(), F.lit(False)), F.coalesce(kind == "voice", F.lit(False))
    return (
        F.when(pressed, F.struct(choice.alias("response"), none.alias("text"), none.alias("transcript"), none.alias("audio_url"), choice.isin("yes", "anon").alias("confirms"), F.lit(False).alias("needs_text")))
        .when(spoken & transcript.isNull(), F.struct(none.alias("response"), none.alias("text"), none.alias("transcript"), audio_url.alias("audio_url"), F.lit(False).alias("confirms"), F.lit(True).alias("needs_text")))
        .when(spoken, F.struct(F.lit("voice").alias("response"), transcript.alias("text"), transcript.alias("transcript"), audio_url.alias("audio_url"), F.lit(False).alias("confirms"), F.lit(False).alias("needs_text")))
        .otherwise(F.struct(F.lit("text").alias("response"), text.alias("text"), none.alias("transcript"), none.alias("audio_url"), F.lit(False).alias("confirms"), F.lit(False).alias("needs_text")))
    )


def command_of(text: Column) -> Column:
    """The command a message gives, ``/name`` in small letters without an addressee; null for plain text."""
    return F.when(text.startswith("/"), F.lower(F.regexp_extract(text, r"^/([A-Za-z0-9_]+)", 1)))
