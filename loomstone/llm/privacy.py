"""Personal data in free text: detection, typed placeholders and keyed surrogates.

Numbers and addresses are found by their forms, written or spoken, with their checks (Luhn,
octets, groups). Names of persons are found by a name model: the given and family names of a
table of known people, those that stand in mail headers and after titles in any of the texts, and
the word endings several of these share.

Every mention found is replaced: by the placeholder of its kind, or by a surrogate, a made-up entity of the same
type, gender, script and format (see ``surrogates``). What was replaced is what was found.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm import surrogates
from loomstone.llm.common import by_bytes, cut
from loomstone.llm.surrogates import luhn

KINDS = ("email", "phone", "sin", "cc", "ip", "address", "person")
PLACEHOLDERS = {k: f"[REDACTED_{k.upper()}]" for k in KINDS}
RARE = 5 / 12_000
"""A word written small in more than this share of the texts is a common one; five texts are no evidence in any case."""


NAME_SHARE = 1e-6
"""A word is learned as a name if it stands at a name's place in at least this share of the texts, once at least; so the names that
every executor holds are bounded however many texts there are. Known people are always names."""


class Entity(NamedTuple):
    start: int
    end: int
    kind: str


# --- numbers -------------------------------------------------------------------------------

# Spoken digits.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
}
_dw = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_SPOKEN = re.compile(rf"\b(?:plus[ ,-]+)?(?:(?:double|triple)[ -]+)?(?:{_dw})(?:[ ,-]+(?:(?:double|triple)[ -]+)?(?:{_dw})){{6,}}\b", re.I)

_EMAIL = re.compile(r"[A-Za-z0-9À-ÿ][A-Za-z0-9À-ÿ._%+-]*[@＠](?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}")
_AT = r"\s*(?:\[\s*at\s*\]|\(\s*at\s*\)|\{\s*at\s*\}|<at>)\s*"
_BRACKET_AT = re.compile(_AT, re.I)
_DOT = r"\s*(?:\[\s*dot\s*\]|\(\s*dot\s*\)|\{\s*dot\s*\}|<dot>|\.)\s*"
_EMAIL_BRACKET = re.compile(rf"[\w.+%-]+{_AT}[\w-]+(?:{_DOT}[\w-]+)+", re.I)
_EMAIL_SPOKEN = re.compile(r"\b[\w+-]+(?: (?:dot|underscore|dash|hyphen|plus|point|tiret) [\w+-]+)* (?:at|arobase|arobas) [\w-]+(?: (?:dot|point) [\w-]+)+", re.I)
# One scan for everything made of digits; what it is, its digits and groups decide.
_NUMBER = re.compile(r"(?<![\w.@/$€£#])(?:\+\s?)?\(?\d(?:[\d().–‑‐-]|[ \u00a0\u2007\u202f\u2009](?=[\d(])|\) ?(?=\d))*\d(?![\w@])")
_IP4 = re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)")
_IP6 = re.compile(r"(?<![\w:.])(?:(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}|(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,6})?::(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,6})?)(?![\w:])", re.I)
_DIGITS = re.compile("[0-9][0-9()., \u00a0\u202f\u2007\u2009–‑‐-]{5,}[0-9]")
_NANP = re.compile(r"^(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-]?)\d{3}[ .-]?\d{4}$")
_SIN = re.compile(r"^\d{3}([ .-]?)\d{3}\1\d{3}$")
_DASHES = str.maketrans("–‑‐\u00a0\u2007\u202f\u2009", "---    ")


def _number_kind(raw: str) -> str | None:
    s = raw.translate(_DASHES)
    digits = re.sub(r"\D", "", s)
    n = len(digits)
    if s.startswith("+"):
        return "phone" if 7 <= n <= 15 else None
    if n == 9:
        return "sin" if _SIN.match(s) and luhn(digits) else None
    if n in (10, 11):
        return "phone" if _NANP.match(s) and (n == 10 or digits[0] == "1") else None
    if 13 <= n <= 19 and "(" not in s and "." not in s and luhn(digits):
        return "cc"
    return None


def spoken_digits(text: str) -> str:
    out, times = "", 1
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        if w in ("double", "triple"):
            times = 2 if w == "double" else 3
        elif w in DIGIT_WORDS:
            out += DIGIT_WORDS[w] * times
            times = 1
    return out


# --- addresses -----------------------------------------------------------------------------

# Kinds of streets after and before a name, and written house numbers.
_STREET = r"(?:street|st|avenue|ave|road|rd|crescent|cres|lane|ln|drive|dr|boulevard|blvd|court|ct|place|pl|square|terrace|way)"
_RUE = r"(?:rue|avenue|boulevard|boul|chemin|place|allée|impasse|quai)"
_TENS = r"(?:twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety)"
_UNITS = r"(?:one|two|three|four|five|six|seven|eight|nine)"
_TEENS = r"(?:ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen)"
_SMALL = rf"(?:{_TENS}(?:[- ]{_UNITS})?|{_TEENS}|{_UNITS})"
_HOUSE = rf"(?:\d{{1,5}}(?:\s?[-–]\s?\d{{1,5}})?(?:\s?(?:bis|ter)\b)?[a-d]?|(?:{_UNITS} hundred(?: and)?(?: {_SMALL})?|{_SMALL})(?: {_SMALL})?)"
_NAME = r"[A-Za-zÀ-ÿ][\w'’-]+"
_ADDRESS = re.compile(
    rf"(?<![\w.$€£])(?:(?:suite|unit|apt\.?|apartment|bureau|app\.?)\s+#?\w+,?\s+)?{_HOUSE},?\s+"
    rf"(?:{_RUE}\s+(?:de la |de l['’]|des |du |de |d['’])?{_NAME}(?: {_NAME})?|{_NAME}(?: {_NAME})? {_STREET}\b\.?)"
    rf"(?:,?\s+(?:in |à )?[A-ZÀ-Ý][\w'’-]+(?:[ -][A-ZÀ-Ý][\w'’-]+)?)?",
    re.I,
)
_STRASSE = re.compile(rf"(?<![\w@])[A-Za-zÀ-ÿ][\w-]*(?:straße|strasse|str\.|gasse|platz|allee) ?\d{{1,4}}\s?[a-d]?\b(?:,? \d{{5}} {_NAME}(?:[ -][A-ZÀ-Ý][\w-]+)?)?", re.I)
_STREET_WORDS = set(re.findall(r"[^\W\d_]+", _STREET + _RUE))

# --- names ---------------------------------------------------------------------------------

_W = r"[A-ZÀ-ÖØ-Þ][^\W\d_]*[a-zß-öø-ÿ][^\W\d_]*"
_HEADER = re.compile(
    rf"(?m)(?:^[>| \t]*\*?(?:From|To|De|À|Von|An|Cc)\s?:\*?[ \t]+({_W}) ({_W})[ \t]*(?:<|\r?$)"
    rf"|\bschrieb ({_W}) ({_W})(?= <|:)|\bGMT, ({_W}) ({_W})(?= <|:)|(?:\d, |^[>| \t]*)({_W}) ({_W})(?: <[^>\n]+>)? (?:wrote|a écrit)\b|\bDr\.? ({_W}) ({_W}))"
)
# What every match of the pattern above holds.
_HEADER_MARK = re.compile(r"(?:From|To|De|À|Von|An|Cc)\s?:|schrieb|GMT,|wrote|a écrit|Dr\b")
_WORDS = re.compile(r"[^\W\d_]+")
_COMMON = re.compile(r"(?<![\w@＠.+-])[^\W\d_]+(?![\w@＠+-]|\.\w)")


def _low(n: int) -> int:
    """In so many of ``n`` texts a common word is at most written small by chance."""
    return max(5, int(n * RARE))


def _count(texts: Iterable[str | None]) -> tuple[int, dict[str, list[int]]]:
    """How many texts there are, and of each word how often it stands as given and as family name in
    headers and after titles, and in how many texts it is written small."""
    n, counts = 0, {}
    for t in texts:
        if not t:
            continue
        n += 1
        for m in _HEADER.finditer(t) if _HEADER_MARK.search(t) else ():
            pair = [x for x in m.groups() if x]
            if len(pair) == 2 and "redacted" not in m[0].lower():
                for i, w in enumerate(pair):
                    counts.setdefault(w.lower(), [0, 0, 0])[i] += 1
        for w in set(_COMMON.findall(t)):
            if w[0].islower():
                counts.setdefault(w, [0, 0, 0])[2] += 1
    return n, counts


class NameModel:
    """Given names, family names and the endings of each that several names share."""

    def __init__(self, known: Iterable[tuple[str | None, str | None]], texts: Iterable[str | None]):
        n, counts = _count(texts)
        low = _low(n)
        # As over tables: a word written small in few texts that stands beside no name tells nothing.
        self._settle(known, ((w, *c) for w, c in counts.items() if c[0] or c[1] or c[2] > low), low)

    @classmethod
    def of_counts(cls, known: Iterable[tuple[str | None, str | None]], counts: Iterable[tuple[str, int, int, int]], n: int) -> NameModel:
        """From ``(word, times a given name, times a family name, texts with it written small)`` over ``n`` texts."""
        model = cls.__new__(cls)
        model._settle(known, counts, _low(n))
        return model

    def _settle(self, known: Iterable[tuple[str | None, str | None]], counts: Iterable[tuple[str, int, int, int]], low: int) -> None:
        self.no_names: set[str] = set()
        known = list(known)
        given = {g.lower() for g, _ in known if g}
        family = {f.lower() for _, f in known if f}
        seen_g: Counter = Counter()
        seen_f: Counter = Counter()
        words: Counter = Counter()
        for w, g, f, n in counts:
            for counter, times in ((seen_g, g), (seen_f, f), (words, n)):
                if times:
                    counter[w] = times
        # A word often written small, and not in an address, is a common word and no name.
        self.given = {g for g in given | set(seen_g) if len(g) > 2 and (g in given or words[g] <= low + 2 * seen_g[g])}
        self.family = {f for f in family | set(seen_f) if len(f) > 2 and (f in family or words[f] <= low + 2 * seen_f[f])}
        for n in self.given | self.family:
            del words[n]
        self.common = {w for w, n in words.items() if n > low}
        self.given_end = self._endings(self.given, self.common)
        self.family_end = self._endings(self.family, self.common)

    @staticmethod
    def _endings(names: set[str], words: set[str]) -> set[str]:
        """Endings of three and four letters that at least four names and a hundredth of them share, and by far more names than common words."""
        ends: set[str] = set()
        least = max(4, len(names) // 100)
        for k in (3, 4):
            of = Counter(n[-k:] for n in names if len(n) >= k + 2)
            common = Counter(w[-k:] for w in words if len(w) >= k + 2)
            ends |= {e for e, n in of.items() if n >= least and common[e] * 4 <= n}
        return ends

    def is_given(self, w: str) -> bool:
        w = w.lower()
        return w in self.given or len(w) >= 5 and (w[-4:] in self.given_end or w[-3:] in self.given_end) and w not in self.common

    def is_family(self, w: str) -> bool:
        w = w.lower()
        return w in self.family or len(w) >= 5 and (w[-4:] in self.family_end or w[-3:] in self.family_end) and w not in self.common

    def unknown(self, w: str) -> bool:
        """A capitalised word that may be a name, as it is no common word and none that stands beside names."""
        low = w.lower()
        return len(w) > 2 and w[0].isupper() and (w[1:].islower() or w.isupper()) and low not in _NOT_NAME and low not in self.common

    def names_among(self, words: set[str]) -> bool:
        """Whether some of these small words may be a name."""
        hit = False
        for w in words - self.no_names:
            if self.is_given(w) or self.is_family(w):
                hit = True
            else:
                self.no_names.add(w)
        if len(self.no_names) > 300_000:  # a worker's cache of answers, no limit of the search
            self.no_names.clear()
        return hit

    def __getstate__(self) -> dict:
        return self.__dict__ | {"no_names": set()}  # answers stay in the worker


# A name's places: two words in a row (with a double given name or a middle initial), family name first, or an initial.
_PAIR = re.compile(
    r"(?<![\w@.+=/-])(?P<t>(?:Dr|Mr|Mrs|Ms|Mme|Prof)\.? )?(?P<a>[^\W\d_]{2,}|[A-ZÀ-Þ]\.)(?:-(?P<a2>[^\W\d_]{2,}))?(?P<c>,)?[ \u00a0]"
    r"(?:[A-ZÀ-Þ]\. )?(?P<b>[^\W\d_]{2,}|[A-ZÀ-Þ](?=[.,;:)\]\s]|$))(?![\w@=+/]|[.-]\w)"
)
_TITLED = re.compile(r"\b(?:Dr|Mr|Mrs|Ms|Mme|Prof)\.? (?P<a>[^\W\d_]{3,})(?![\w@]|[.-]\w)", re.I)
_LONE = re.compile(r"(?<![\w@.+=/-])[A-ZÀ-Þ][^\W\d_]{3,}(?![\w@=+/]|[.-]\w)")


def _names(text: str, model: NameModel) -> list[tuple[int, int]]:
    out = []
    pos = 0
    given, family, unknown = model.is_given, model.is_family, model.unknown
    while m := _PAIR.search(text, pos):
        a, a2, b = m["a"], m["a2"], m["b"]
        pos = m.end("a")  # the second word may begin the next pair
        upper = a[0].isupper() and b[0].isupper()
        if m["c"]:  # family name, given name
            hit = family(a) and (given(b) or a.isupper() and unknown(b)) or a.isupper() and len(a) > 3 and a not in ("NOTICE", "AVIS") and given(b)
        elif len(b) == 1:  # given name and an initial
            hit = upper and given(a)
        elif a.endswith("."):
            hit = family(b)
        else:
            g = given(a) or a2 is not None and given(a2)
            f = family(b)
            hit = g and f or upper and (g and unknown(b) or f and unknown(a) or bool(m["t"]) and unknown(a) and unknown(b) and b[1:].islower())
        if hit:
            out.append(m.span())
            pos = m.end()
    out += [m.span() for m in _TITLED.finditer(text) if family(m["a"])]
    # A name standing alone, where it is one of the known or learned names.
    known = model.given | model.family
    out += [m.span() for m in _LONE.finditer(text) if m[0].lower() in known]
    return out


_NOT_NAME = set(
    # Words of firms, streets, months, days, roles and greetings that can stand beside a name.
    """hi hello hey dear thanks regards cheers from to de from ask dr mr mrs the and or by with for this that on at in it is was will has have user assistant subject re fwd tr
    monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december
    street road avenue ave crescent lane drive group company inc ltd gmbh logistics foods services partners house
    manager director controller partner lead analyste principal service desk operations external accountant redacted person email phone address
    bonjour merci cordialement hallo according contact nobody same please approved my colleague met loop names form still wrote schrieb""".split()
)


# --- detection -----------------------------------------------------------------------------

_SPOKEN_MARKS = set(DIGIT_WORDS)
_TITLES = {"dr", "mr", "mrs", "ms", "mme", "prof"}


def find(text: str | None, model: NameModel) -> list[Entity]:
    """Entities of a text, in order, without overlap: the longer, then the earlier kind of ``KINDS`` holds.

    A null or empty text has none; placeholders (``[REDACTED_...]``) are none.
    """
    if not text:
        return []
    found: list[Entity] = []
    low = text.lower()
    words = set(_WORDS.findall(low))
    if "@" in text or "＠" in text:
        found += [Entity(*m.span(), "email") for m in _EMAIL.finditer(text)]
    if "at" in words and ("dot" in words or "point" in words or _BRACKET_AT.search(low)) or "arobase" in words or "arobas" in words:
        found += [Entity(*m.span(), "email") for p in (_EMAIL_BRACKET, _EMAIL_SPOKEN) for m in p.finditer(text)]
    for run in _DIGITS.finditer(text):
        for m in _NUMBER.finditer(text, max(0, run.start() - 3), min(len(text), run.end() + 2)):
            if m.end() - m.start() < 7 or m.end() > run.end() or m.end() < len(text) and (text[m.end()].isalnum() or text[m.end()] in "_@"):
                continue
            raw, at = m[0], m.start()
            if raw[0] == "(" and ")" not in raw:  # the bracket holds more than the number
                raw, at = raw[1:], at + 1
            kind = _number_kind(raw)
            if kind:
                found.append(Entity(at, m.end(), kind))
            elif " " in raw or "." in raw:
                found += _inside(raw, at)
    if "." in text:
        for m in _IP4.finditer(text):
            if all(int(x) < 256 for x in m[0].split(".")) and not re.search(r"(?:[Vv]ersion|[Bb]uild|v)\s*$", text[max(0, m.start() - 9) : m.start()]):
                found.append(Entity(*m.span(), "ip"))
    if ":" in text and ("::" in text or text.count(":") >= 7):
        found += [Entity(*m.span(), "ip") for m in _IP6.finditer(text) if len(m[0]) > 4]
    if not words.isdisjoint(_SPOKEN_MARKS) and sum(map(low.count, DIGIT_WORDS)) >= 7:  # every match holds seven of them
        for m in _SPOKEN.finditer(text):
            d = spoken_digits(m[0])
            kind = "sin" if len(d) == 9 else "phone" if len(d) in (7, 10, 11, 12) else "cc" if 13 <= len(d) <= 19 else None
            if kind:
                found.append(Entity(*m.span(), kind))
    if not words.isdisjoint(_STREET_WORDS):
        found += [Entity(*m.span(), "address") for m in _ADDRESS.finditer(text)]
    if "stra" in low or "str." in low or "platz" in low or "gasse" in low or "allee" in low:
        found += [Entity(*m.span(), "address") for m in _STRASSE.finditer(text)]
    if not words.isdisjoint(_TITLES) or model.names_among(words):
        found += [Entity(s, e, "person") for s, e in _names(text, model)]
    if len(found) < 2:
        return found
    found.sort(key=lambda x: (x.start, -x.end, KINDS.index(x.kind)))
    out: list[Entity] = []
    for x in found:
        if not out or x.start >= out[-1].end:
            out.append(x)
    return out


_RUNS = re.compile(r"\d+")


def _inside(raw: str, at: int) -> list[Entity]:
    """Numbers that stand beside other digits: windows of neighbouring groups."""
    runs = [m.span() for m in _RUNS.finditer(raw)]
    i, out = 0, []
    while i < len(runs):
        for j in range(min(len(runs), i + 7), i, -1):
            s, e = runs[i][0], runs[j - 1][1]
            if s and raw[s - 1] == "+":
                s -= 1
            kind = _number_kind(raw[s:e]) if e - s >= 9 else None
            # Ten or nine bare digits are only taken whole; a part needs its separators.
            if kind and (j - i > 1 or raw[s] == "+" or kind == "cc"):
                out.append(Entity(at + s, at + e, kind))
                i = j
                break
        else:
            i += 1
    return out


def redact(text: str | None, model: NameModel) -> str | None:
    """The text with each entity replaced by its placeholder; the rest unchanged. Null stays null."""
    if not text:
        return text
    out, at = [], 0
    for x in find(text, model):
        out += [text[at : x.start], PLACEHOLDERS[x.kind]]
        at = x.end
    return "".join(out) + text[at:] if out else text


# --- over tables ---------------------------------------------------------------------------


def fit_names(texts: DataFrame, text: str, known: DataFrame) -> NameModel:
    """A name model from ``known (given_name, family_name)``, a small fixed table, and all the texts.

    Each distinct text counts once. Words are counted where the texts lie and only words and their
    counts move; the driver gets the names and the common words, which ``NAME_SHARE`` and ``RARE`` bound.
    """
    one = texts.select(F.col(text).alias("t")).where(F.length("t") > 0).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, counts = _count(b.column(0).to_pylist())
            counts[""] = [0, 0, n]  # no word: the texts
            cols = [pa.array([c[i] for c in counts.values()], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *cols], ["w", "g", "f", "n"])

    sums = [F.sum(c).alias(c) for c in ("g", "f", "n")]
    words = cut(one.mapInArrow(run, "w string, g bigint, f bigint, n bigint").groupBy("w").agg(*sums), "words")
    n = sum(r.n for r in words.df.where("w = ''").collect())
    least = max(1, int(n * NAME_SHARE))
    kept = words.df.where("w <> ''").where((F.col("g") >= least) | (F.col("f") >= least) | (F.col("n") > _low(n)))
    counts = [tuple(r) for r in kept.collect()]
    words.drop()
    pairs = [(r.given_name, r.family_name) for r in known.select("given_name", "family_name").toLocalIterator()]
    return NameModel.of_counts(pairs, counts, n)


def _mapped(df: DataFrame, key: str, text: str, model: NameModel, schema: str, each) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(model)  # names and common words, bounded by NAME_SHARE and RARE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in by_bytes(b, 1):
                yield from each(part, shared.value)

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, schema)


def redacted(df: DataFrame, key: str, text: str, model: NameModel) -> DataFrame:
    """``(key, text, log)``: every row's text with placeholders, and the log of what was replaced, with
    offsets in code points of the original. A null text stays null with an empty log."""
    t = df.schema[key].dataType
    entry = pa.struct([("type", pa.string()), ("offset", pa.int32()), ("replacement", pa.string())])

    def each(b, m):
        texts, logs = [], []
        for x in b.column(1).to_pylist():
            found = find(x, m)
            logs.append([{"type": e.kind, "offset": e.start, "replacement": PLACEHOLDERS[e.kind]} for e in found])
            texts.append(redact(x, m) if found else x)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(logs, pa.list_(entry))], ["k", "text", "log"])

    schema = f"k {t.simpleString()}, text string, log array<struct<type string, offset int, replacement string>>"
    return _mapped(df, key, text, model, schema, each).withColumnRenamed("k", key)


def mentions(df: DataFrame, key: str, text: str, model: NameModel) -> DataFrame:
    """``(key, start, end, kind, raw)`` of every mention of an entity. Null and empty texts have none; keys may be null
    or repeated; other columns are not read; an empty table gives an empty one."""
    t = df.schema[key].dataType

    def each(b, m):
        cols: list[list] = [[] for _ in range(5)]
        for i, x in enumerate(b.column(1).to_pylist()):
            for e in find(x, m):
                for c, val in zip(cols, (i, e.start, e.end, e.kind, x[e.start : e.end])):
                    c.append(val)
        types = [pa.int32(), pa.int32(), pa.string(), pa.string()]
        arrays = [b.column(0).take(pa.array(cols[0], pa.int32()))] + [pa.array(c, ty) for c, ty in zip(cols[1:], types)]
        yield pa.RecordBatch.from_arrays(arrays, ["k", "start", "end", "kind", "raw"])

    return _mapped(df, key, text, model, f"k {t.simpleString()}, start int, `end` int, kind string, raw string", each).withColumnRenamed("k", key)


def replaced(df: DataFrame, key: str, text: str, model: NameModel, secret: bytes) -> DataFrame:
    """``(key, start, end, kind, raw, surrogate)``: every mention with what stands in its place. Mentions of one
    entity have surrogates of one made-up entity in all rows, each in the mention's own writing."""
    found = cut(mentions(df, key, text, model), "mentions").df
    shared = df.sparkSession.sparkContext.broadcast(model)
    made = surrogates.of_mentions(found, secret, lambda: _lone_given(shared.value), spoken_digits)
    return found.join(cut(made, "made").df, ["kind", "raw"])


def _lone_given(model: NameModel):
    return lambda w: w.lower() in model.given and w.lower() not in model.family


def kinds(df: DataFrame, key: str, text: str, model: NameModel, secret: bytes) -> DataFrame:
    """``(key, kind)``: the kinds of personal data that were replaced in each row's text, each once a key. Rows
    without any have no row; keys may be null or repeated; other columns are not read; an empty table gives an empty one."""
    return replaced(df, key, text, model, secret).where("surrogate <> raw").select(key, "kind").distinct()


def with_surrogates(df: DataFrame, key: str, text: str, model: NameModel, secret: bytes) -> DataFrame:
    """``(key, text)``: every row's text with surrogates in place of its entities; one row per distinct
    non-null key. The same entity has the same surrogate in all rows."""
    put = replaced(df, key, text, model, secret)
    # All mentions of one text, bounded by the text.
    edits = put.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("start", "end", "surrogate"))).alias("edits"))
    one = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.col(text)).alias("t"))
    t = df.schema[key].dataType

    def splice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for x, es in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                out, at = [], 0
                for e in es or ():
                    out += [x[at : e["start"]], e["surrogate"]]
                    at = e["end"]
                texts.append("".join(out) + x[at:] if out else x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["k", "text"])

    both = one.join(edits, key, "left").select(F.col(key).alias("k"), "t", "edits")
    return both.mapInArrow(splice, f"k {t.simpleString()}, text string").withColumnRenamed("k", key)
