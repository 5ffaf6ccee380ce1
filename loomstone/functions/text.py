"""Text functions as columns; all stay in the JVM. Null in, null out unless said otherwise.

Positions and lengths are code points. ``SPACE`` is the one class of blank characters used
everywhere, as the engines' ``\\s`` differ.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: blank characters.
BLANKS = r"\t\n\x0b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
SPACE = f"[{BLANKS}]"

# Words that carry no topic in a gap phrase.
GAP_STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "been", "being", "but", "by", "for", "from", "how", "in", "is", "it", "of", "on", "or",
    "that", "the", "this", "to", "was", "were", "when", "where", "will", "with",
]
# Long words that say nothing of their own.
COMMON_LONG_WORDS = [
    "because", "through", "however", "therefore", "although", "business", "businesses", "company", "companies", "customer", "customers", "service",
    "services", "solution", "solutions", "important", "different", "something", "everything", "available", "technology", "organization", "management",
]


def squeeze(c: Column) -> Column:
    """Runs of blanks as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def strip_html(c: Column) -> Column:
    """Readable text of HTML: scripts and styles go, tags become blanks, six entities are decoded in
    turn (so a doubly escaped one is decoded twice), blanks are squeezed."""
    x = F.regexp_replace(c, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " ")
    x = F.regexp_replace(x, r"<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    return squeeze(x)


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def clamp(c: Column, n: int = 80) -> Column:
    """Squeezed and cut to ``n`` characters."""
    return F.substring(squeeze(c), 1, n)


def words(c: Column) -> Column:
    return F.filter(F.split(squeeze(c), " "), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def first_words(c: Column, n: int = 80) -> Column:
    """The first ``n`` words; an ellipsis shows that more followed."""
    w = words(c)
    return F.when(F.size(w) > n, F.concat(F.array_join(F.slice(w, 1, n), " "), F.lit("…"))).otherwise(F.array_join(w, " "))


def cut_at_boundary(c: Column, n: int) -> Column:
    """At most ``n`` characters: up to the last sentence end if that lies in the second half, else up to
    the last blank, else cut hard."""
    head = F.substring(c, 1, n)
    sentence = F.length(F.regexp_extract(head, r"(?s)^(.*[.!?]) ", 1))
    blank = F.length(F.regexp_extract(head, r"(?s)^(.*) ", 1))
    shorter = F.when(sentence > n / 2, F.substring(head, F.lit(1), sentence)).when(blank > 0, F.substring(head, F.lit(1), blank)).otherwise(head)
    return F.when(F.length(c) <= n, c).otherwise(shorter)


def gap_tokens(c: Column) -> Column:
    """Small words of a phrase without stop words, in order, repeats kept."""
    stop = F.array(*[F.lit(w) for w in GAP_STOP_WORDS])
    return F.filter(words(F.lower(c)), lambda w: ~F.array_contains(stop, w))


def alphanumeric_tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"[A-Za-z0-9]+"), F.lit(0))


def distinctive_tokens(c: Column) -> Column:
    """Distinct small tokens that point to one thing: of three or more characters with a digit or all
    capitals, or of seven or more letters and not a common long word."""
    common = F.array(*[F.lit(w) for w in COMMON_LONG_WORDS])

    def keep(t: Column) -> Column:
        with_digit = t.rlike("[0-9]") & (F.length(t) >= 3)
        capitals = t.rlike("^[A-Z]{3,}$")
        long_word = t.rlike("^[A-Za-z]{7,}$") & ~F.array_contains(common, F.lower(t))
        return with_digit | capitals | long_word

    return F.array_distinct(F.transform(F.filter(alphanumeric_tokens(c), keep), F.lower))


def digit_count(c: Column) -> Column:
    return F.length(F.regexp_replace(c, "[^0-9]", ""))


def fenced_json(c: Column) -> Column:
    """The inside of one code fence, or the text itself, trimmed."""
    inner = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.regexp_replace(F.when(inner != "", inner).otherwise(c), f"^{SPACE}+|{SPACE}+$", "")


def clean_title(title: Column, fallback: Column, n: int = 80) -> Column:
    """Trimmed, without outer quotes, cut; the fallback where nothing is left."""
    t = F.substring(F.trim(F.regexp_replace(F.trim(title), r"^[\"'“”]+|[\"'“”]+$", "")), 1, n)
    return F.coalesce(F.nullif(t, F.lit("")), fallback)


def primary_keyword(keywords: Column, label: Column) -> Column:
    return F.lower(F.coalesce(F.try_element_at(keywords, F.lit(1)), label))


def chunk_source_id(source: Column, key: Column, n: Column) -> Column:
    """``source:key:chunk-0007``; numbers above four digits are not cut."""
    s = n.cast("string")
    return F.concat_ws(":", source, key, F.concat(F.lit("chunk-"), F.lpad(s, F.greatest(F.lit(4), F.length(s)), F.lit("0"))))


def posix_path(c: Column) -> Column:
    return F.replace(c, F.lit("\\"), F.lit("/"))


def normal_path(c: Column) -> Column:
    """Small, with single forward slashes and none at the end."""
    return F.regexp_replace(F.regexp_replace(F.lower(posix_path(c)), "/+", "/"), "/$", "")


def under_any(path: Column, prefixes: list[str]) -> Column:
    """Whether a path begins with one of the prefixes, as plain strings; an empty prefix never matches."""
    p = normal_path(path)
    hits = [p.startswith(x) for x in (q.lower().replace("\\", "/").rstrip("/") for q in prefixes) if x]
    out = F.lit(False)
    for h in hits:
        out = out | h
    return F.coalesce(out, F.lit(False))


def workspace_of(path: Column) -> Column:
    """The last UUID among a path's folders, the leaf not counted."""
    folders = F.split(F.regexp_replace(posix_path(path), "/[^/]*$", ""), "/")
    ids = F.filter(folders, lambda s: s.rlike(r"^(?i)[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}$"))
    return F.try_element_at(ids, F.lit(-1))


def transcript_class(path: Column) -> Column:
    """What a transcript's path says: ``kept, is_subagent, is_compact, slug``."""
    p = posix_path(path)
    leaf = F.element_at(F.split(p, "/"), -1)
    return F.struct(
        ((leaf != "audit.jsonl") & p.contains("/projects/") & leaf.endswith(".jsonl")).alias("kept"),
        p.contains("/subagents/").alias("is_subagent"),
        leaf.startswith("agent-acompact-").alias("is_compact"),
        F.nullif(F.regexp_extract(p, r".*-sessions-([^/]+)", 1), F.lit("")).alias("slug"),
    )


def continuation_group(slug: Column, first_text: Column) -> Column:
    """A key under which the parts of one continued session meet; null where either is empty."""
    text = F.substring(F.trim(first_text), 1, 200)
    return F.when((slug != "") & (text != ""), F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit("v1|"), slug, F.lit("|"), text), 256)))


def sha256_of_address(c: Column) -> Column:
    return F.sha2(F.lower(F.trim(c)), 256)


# The field of a tool's payload that says what the call was about; names are matched exactly.
SUMMARY_FIELDS = {
    "Bash": "command", "mcp__workspace__bash": "command",
    "Edit": "file_path", "Write": "file_path", "Read": "file_path",
    "mcp__Claude_in_Chrome__navigate": "url",
    "WebFetch": "url", "mcp__workspace__web_fetch": "url",
    "WebSearch": "query",
    "Glob": "pattern", "Grep": "pattern",
    "mcp__cowork__present_files": "files",
    "TaskCreate": "subject", "TaskUpdate": "subject",
    "AskUserQuestion": "questions",
}
SEARCH_TOOL = r"^mcp__[^_].*__search$"


def tool_summary(tool: Column, payload: Column) -> Column:
    """What a tool call was about, at most 80 characters, from its JSON payload; null where it says nothing
    or the tool is not known.

    A field counts only if it is a JSON string and not empty. Of a shell command the one line that is
    not blank, of several only that there are some; of presented files their paths.
    """
    v = F.try_parse_json(payload)

    def string(path: str) -> Column:
        typed = F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING"
        return F.nullif(F.when(typed, F.try_variant_get(v, path, "string")), F.lit(""))

    def of(field: str) -> list[str]:
        return [t for t, f in SUMMARY_FIELDS.items() if f == field]

    lines = F.filter(F.split(string("$.command"), "\n"), lambda x: squeeze(x) != "")
    shell = F.when(F.size(lines) > 1, F.lit("bash (multi-line)")).when(F.size(lines) == 1, lines[0])

    def path_of(f: Column) -> Column:
        inner = F.try_variant_get(f, "$.file_path", "variant")
        return F.when(F.schema_of_variant(f) == "STRING", F.try_variant_get(f, "$", "string")).when(F.schema_of_variant(inner) == "STRING", F.try_variant_get(f, "$.file_path", "string"))

    files = F.array_join(F.filter(F.transform(F.try_variant_get(v, "$.files", "array<variant>"), path_of), lambda p: p.isNotNull()), ", ")
    value = (
        F.when(tool.isin(of("command")), shell)
        .when(tool.isin(of("file_path")), string("$.file_path"))
        .when(tool.isin(of("url")), string("$.url"))
        .when(tool.isin(of("query")) | tool.rlike(SEARCH_TOOL), string("$.query"))
        .when(tool.isin(of("pattern")), string("$.pattern"))
        .when(tool.isin(of("files")), files)
        .when(tool.isin(of("subject")), F.coalesce(string("$.subject"), string("$.title")))
        .when(tool.isin(of("questions")), string("$.questions[0].question"))
    )
    return F.when(value != "", clamp(value))


def without_secret(c: Column, secret: str) -> Column:
    return F.replace(c, F.lit(secret), F.lit("***")) if secret else c


def correction_lines(failures: Column) -> Column:
    """One line for each ``{rule_id, instruction}``."""
    return F.array_join(F.transform(failures, lambda f: F.concat(F.lit("- "), f["rule_id"], F.lit(": "), f["instruction"])), "\n")


def place_of(text: Column, offset: Column) -> Column:
    """``paragraph p, sentence s`` of a 0-based offset."""
    head = F.substring(text, F.lit(1), offset)
    paragraphs = F.split(head, r"\n\s*\n")
    sentences = F.split(F.element_at(paragraphs, -1), r"(?<=[.!?])\s+")
    return F.concat(F.lit("paragraph "), F.size(paragraphs), F.lit(", sentence "), F.size(sentences))


def earliest_phrase(text: Column, phrases: list[str]) -> Column:
    """``{pos, phrase}`` of the phrase that comes first, whatever its case; null if there is none. Of
    phrases at one place the longest counts."""
    low = F.lower(text)
    found = F.array(*[F.struct(F.instr(low, p.lower()).alias("pos"), F.lit(-len(p)).alias("l"), F.lit(p).alias("phrase")) for p in phrases])
    best = F.array_min(F.filter(found, lambda x: x["pos"] > 0))
    return F.when(best.isNotNull(), F.struct(best["pos"].alias("pos"), best["phrase"].alias("phrase")))
