"""Bounded texts from ordered parts, and ordered checks of a text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomstone.functions import text as X

MARKER_ROOM = 80


def insights(parts: Column, budget: int = 15_000, prefix: Column | None = None) -> Column:
    """``{text, truncated, omitted}``: the prefix and as many parts as fit, in order, blank ones dropped; a
    part that does not fit is skipped for smaller ones behind it.

    If any is left out, the fill is made again with room for a marker that says how many. If nothing
    fits, the first part is cut at a sentence or blank. The whole never exceeds ``budget``.
    """
    p = F.coalesce(prefix, F.lit("")) if prefix is not None else F.lit("")
    clean = F.filter(F.transform(F.coalesce(parts, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    sep = 2
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("used"), F.lit(0).alias("omitted"))

    def fill(room: Column) -> Column:
        def step(s: Column, x: Column) -> Column:
            need = F.length(x) + F.when(F.size(s["kept"]) > 0, sep).otherwise(0)
            fits = s["used"] + need <= room
            return F.struct(
                F.when(fits, F.concat(s["kept"], F.array(x))).otherwise(s["kept"]).alias("kept"),
                (s["used"] + F.when(fits, need).otherwise(0)).cast("int").alias("used"),
                (s["omitted"] + F.when(fits, 0).otherwise(1)).cast("int").alias("omitted"),
            )

        return F.aggregate(clean, start, step)

    room = F.lit(budget) - F.length(p)
    first, second = fill(room), fill(room - MARKER_ROOM)
    head = X.cut_at_boundary(F.try_element_at(clean, F.lit(1)), max(1, budget // 2))
    kept = F.when(first["omitted"] == 0, F.array_join(first["kept"], "\n\n")).when(F.size(second["kept"]) > 0, F.array_join(second["kept"], "\n\n")).otherwise(head)
    omitted = F.when(first["omitted"] == 0, 0).when(F.size(second["kept"]) > 0, second["omitted"]).otherwise(F.size(clean) - 1)
    marker = F.when(omitted == 1, F.lit("\n\n[1 part omitted]")).when(omitted > 1, F.concat(F.lit("\n\n["), omitted.cast("string"), F.lit(" parts omitted]"))).otherwise(F.lit(""))
    text = F.substring(F.concat(p, F.coalesce(kept, F.lit("")), marker), 1, budget)
    return F.struct(text.alias("text"), (first["omitted"] > 0).alias("truncated"), omitted.cast("int").alias("omitted"))


def first_failure(checks: list[tuple[str, Column]]) -> Column:
    """``{rule_id, detail}`` of the first check that fails; a check is a column that is null where it passes."""
    return F.coalesce(*[F.when(c.isNotNull(), F.struct(F.lit(i).alias("rule_id"), c.cast("string").alias("detail"))) for i, c in checks])


def all_failures(checks: list[tuple[str, Column]]) -> Column:
    """The ids of all checks that fail, in order."""
    return F.filter(F.array(*[F.when(c.isNotNull(), F.lit(i)) for i, c in checks]), lambda x: x.isNotNull())


def few_citations(draft: Column, chunks: Column, least: int = 2) -> Column:
    """How many chunks share a distinctive token with the draft, null if enough do."""
    tokens = F.transform(X.alphanumeric_tokens(draft), F.lower)
    n = F.size(F.filter(chunks, lambda c: F.arrays_overlap(X.distinctive_tokens(c), tokens)))
    return F.when(n < least, n)


def few_words(texts: Column, least: int = 100) -> Column:
    n = F.aggregate(F.transform(texts, X.word_count), F.lit(0), lambda s, x: s + x)
    return F.when(n < least, n)


_NUMBER = re.compile(r"\b\d[\d,]*(?:\.\d+)?\b", re.ASCII)
# Words that name a source.
CUES = ["source", "according to", "per", "study", "survey", "report", "research", "data from", "cited", "citation", "reference", "statista", "gartner", "forrester"]
_SOURCED = re.compile(r"(?:https?://|www\.)\S|\b(?:" + "|".join(CUES) + r")\b", re.I | re.ASCII)
# What shows that somebody speaks of their own.
FIRST_PERSON = [r"(?<!\w)I(?!\w)", r"(?i)(?<!\w)we(?!\w)", r"(?i)(?<!\w)my client(?!\w)", r"(?i)(?<!\w)in my experience(?!\w)"]  # \w is ASCII here


def unattributed(text: str, window: int = 200, digits: int = 4) -> tuple[int, str] | None:
    """The first number of four or more digits without an address or a source's name within ``window``
    characters; what the window's edge cuts is judged as it stands inside."""
    for m in _NUMBER.finditer(text):
        if sum(c.isdigit() for c in m[0]) >= digits and not _SOURCED.search(text[max(0, m.start() - window) : m.end() + window]):
            return m.start(), m[0]
    return None


def no_first_person(draft: Column) -> Column:
    """A note where nobody speaks of their own, null else."""
    hit = F.lit(False)
    for p in FIRST_PERSON:
        hit = hit | draft.rlike(p)
    return F.when(~hit, F.lit("no first-person language"))


def title_words(title: Column, patterns: dict[str, str]) -> Column:
    """The label of the first of the patterns (Java regular expressions by label) that a title holds, null if none."""
    return F.coalesce(*[F.when(title.rlike(p), F.lit(label)) for label, p in patterns.items()]) if patterns else F.lit(None).cast("string")


def unattributed_number(draft: Column) -> Column:
    """``{offset, number}`` of :func:`unattributed`; offsets of all matches have no built-in form."""

    @F.pandas_udf("offset int, number string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            got = [unattributed(t) if t else None for t in s]
            yield pd.DataFrame({"offset": pd.array([g[0] if g else None for g in got], dtype="Int32"), "number": pd.Series([g[1] if g else None for g in got], dtype=object)})

    r = run(draft)
    return F.when(r["number"].isNotNull(), r)


def keyword_label(texts: Column, k: int = 5) -> Column:
    """``{label, keywords}``: the deterministic local default of a labelling provider, by the distinctive
    tokens that most texts share."""
    tokens = F.flatten(F.transform(texts, X.distinctive_tokens))
    counted = F.transform(F.array_distinct(tokens), lambda t: F.struct((-F.size(F.filter(tokens, lambda u: u == t))).alias("n"), t.alias("t")))
    top = F.transform(F.slice(F.array_sort(counted), 1, k), lambda x: x["t"])
    return F.struct(F.substring(F.array_join(F.slice(top, 1, 3), " "), 1, 80).alias("label"), top.alias("keywords"))


def joined(texts: Column, n: int = 8_000) -> Column:
    return F.substring(F.array_join(texts, "\n---\n"), 1, n)


def prose(answers: Column) -> Column:
    """The non-empty transcripts or texts of answers, trimmed."""
    return F.filter(F.transform(answers, lambda a: F.trim(F.coalesce(a["transcript"], a["text"], F.lit("")))), lambda x: x != "")




# Questions that ask for nothing.
BANNED_PHRASES = ["what did you work on this week", "tell me about your week", "anything interesting"]


def question_failures(question: Column, specifics: Column, signal_text: Column, most_words: int = 80, banned: list[str] = BANNED_PHRASES) -> Column:
    """All that is wrong with a question: too many words, no specifics, none of them in the text it asks about (whatever the
    case; not told where there are none), a phrase that asks for nothing."""
    low, none = F.lower(signal_text), F.size(F.coalesce(specifics, F.array().cast("array<string>"))) == 0
    stands = F.exists(specifics, lambda s: (s != "") & F.contains(low, F.lower(s)))
    generic = F.lit(False)
    for p in banned:
        generic = generic | F.contains(F.lower(question), F.lit(p))
    checks = [
        ("word_count", F.when(X.word_count(question) > most_words, F.lit("x"))),
        ("no_specifics", F.when(none, F.lit("x"))),
        ("hallucinated_specific", F.when(~none & ~F.coalesce(stands, F.lit(False)), F.lit("x"))),
        ("generic_phrase", F.when(generic, F.lit("x"))),
    ]
    return all_failures(checks)


def category(text: Column, rules: dict[str, list[str]]) -> Column:
    """The category most of whose words stand in a text, the first of equals; null where none does: the deterministic
    local default of a classifying provider."""
    low = F.lower(text)
    hits = [F.struct(sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0)).alias("n"), F.lit(-i).alias("first"), F.lit(name).alias("name")) for i, (name, words) in enumerate(rules.items())]
    best = F.array_max(F.array(*hits))
    return F.when(best["n"] > 0, best["name"])


def brief(keyword: Column, text: Column, location: Column, language: Column, correction: Column, default_location: str, default_language: str) -> Column:
    """A brief as JSON: blank values are the defaults, keys that are not set are left out."""
    set_ = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.to_json(F.struct(
        keyword.alias("focusKeyword"), F.coalesce(set_(location), F.lit(default_location)).alias("location"), F.coalesce(set_(language), F.lit(default_language)).alias("language"), text.alias("insightsText"), set_(correction).alias("correctionInstructions"),
    ))
