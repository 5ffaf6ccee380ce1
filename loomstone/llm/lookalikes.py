"""One form for texts that look the same.

Each character has a quick-check property: it is stable if it is its own form, never composes with the character before
it and never moves. The property is computed once for all characters, from Unicode's quick check for canonical composition,
the combining classes, and the rules below. Runs of characters that are not stable are the unstable segments; each is
isolated with its boundary context, the character before the run, brought to its form, and spliced into the unchanged
rest. A text without such a run is its own form.

The form: canonical composition; full- and half-width forms, styled letters, Latin ligatures, Roman numerals and
presentation spaces in their plain characters; invisible format characters dropped (joiners stay where they
shape emoji or joining scripts, selectors where they choose a picture, tags behind a flag); hyphens that look like ``-`` as ``-``;
line ends as ``\\n``; letters of other scripts drawn like a Latin one as that letter. Case, accents, digits, line
breaks and visible punctuation stay.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import by_bytes, cut

# Letters drawn like a Latin letter in common fonts, with that letter.
LOOKALIKES = dict(
    zip(
        "аеорсухіјѕһԁԛԝӏѵ" "АВЕЅЗІЈКМНОРСТУХԌԜҮѴ" "οιυνρϲϳ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ",
        "aeopcyxijshdqwlv" "ABES3IJKMHOPCTYXGWYV" "oiuvpcj" "ABEZHIKMNOPTYXCJ",
    )
)
for _c in "ЗзιυνӏΙ":
    LOOKALIKES.pop(_c, None)  # drawn differently enough, or like another letter in many fonts
LOOKALIKES["Ι"] = "I"
LOOKALIKES["ν"] = "v"
# The same of Armenian, Cherokee, Coptic and phonetic letters.
LOOKALIKES |= dict(zip("օսհոյցՕՍ" "ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏚᏙᏞᏟᏢᏦᏴᏏ" "ⲞⲟⲢⲣⲤⲥⲬⲭⲘⲚⲔⲎⲒⲦ" "ɑɡ", "ouhnjgOU" "DRTAJEWMHGZSVLCPKBb" "OoPpCcXxMNKHIT" "ag"))
# The same letters with marks, from the rule that a letter and its marks are drawn one by one.
for _o in [*range(0x370, 0x530), *range(0x1F00, 0x2000)]:
    _d = unicodedata.normalize("NFD", chr(_o))
    if len(_d) > 1 and _d[0] in LOOKALIKES:
        LOOKALIKES[chr(_o)] = unicodedata.normalize("NFC", LOOKALIKES[_d[0]] + _d[1:])

# Characters without a mark of their own.
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\u206a\u206b\u206c\u206d\u206e\u206f\ufeff"
JOINERS = "\u200c\u200d"
SPACES = "\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
HYPHENS = "‐‑"
LINE_ENDS = "\u0085\u2028\u2029"

SELECTORS = "\ufe00-\ufe0f"
TAGS = "\U000e0001\U000e0020-\U000e007f"
ONE = {**LOOKALIKES, **dict.fromkeys(INVISIBLE, ""), **dict.fromkeys(SPACES, " "), **dict.fromkeys(HYPHENS, "-"), **dict.fromkeys(LINE_ENDS, "\n"), "µ": "μ"}
_joiner = re.compile(f"[{JOINERS}]")
_invisible = re.compile(f"[{INVISIBLE}]+")
_selector = re.compile(f"[{SELECTORS}]")
_tags = re.compile(f"(\U0001f3f4?)([{TAGS}]+)")


def _plain(c: str) -> str:
    """A character's own rule: its plain characters, itself if it has none."""
    if c in ONE:
        return ONE[c]
    d = unicodedata.decomposition(c)
    if d.startswith(("<wide>", "<narrow>", "<font>")) or "\ufb00" <= c <= "\ufb06" or "\u2160" <= c <= "\u217f":
        return "".join(ONE.get(x, x) for x in unicodedata.normalize("NFKC", c))
    return c


class _Properties:
    """The table of plain characters and the pattern of unstable segments, computed on first use."""

    def __init__(self) -> None:
        self.table: dict[int, str] = {}
        unstable: list[int] = []
        second = set()  # characters that compose with the one before them: quick check says maybe
        points = [o for o in (*range(0x80, 0xD800), *range(0xE000, 0x20000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE01F0))]
        for o in points:
            d = unicodedata.decomposition(chr(o))
            if d and d[0] != "<" and " " in d:
                second.add(int(d.split()[1], 16))
        second.update(range(0x1161, 0x1176))
        second.update(range(0x11A8, 0x11C3))
        for o in points:
            c = chr(o)
            if unicodedata.category(c) == "Cn":
                continue
            p = _plain(c)
            if p != c:
                self.table[o] = p
            if p != c or o in second or unicodedata.combining(c) or not unicodedata.is_normalized("NFC", c) or c in JOINERS:
                unstable.append(o)
        ranges, lo = [], None
        # Beyond the first plane one range is far faster to match; what is stable there stays as it is.
        unstable = [o for o in unstable if o < 0x10000]
        for o, after in zip(unstable, [*unstable[1:], -1]):
            lo = o if lo is None else lo
            if after != o + 1:
                ranges.append(f"{re.escape(chr(lo))}-{re.escape(chr(o))}")
                lo = None
        self.segment = re.compile(f"[^\\s]?[{''.join(ranges)}\U00010000-\U0010ffff]+")


_properties: list[_Properties] = []


def properties() -> _Properties:
    if not _properties:
        _properties.append(_Properties())
    return _properties[0]


def _shapes(c: str) -> bool:
    """Whether a joiner beside this character can change what is seen: emoji and joining scripts."""
    o = ord(c) if c else 0
    return 0x1F000 <= o <= 0x1FAFF or 0x2600 <= o <= 0x27BF or o in (0xFE0F, 0x2640, 0x2642, 0x2695) or 0x0600 <= o <= 0x08FF or 0x0900 <= o <= 0x0DFF or 0x1800 <= o <= 0x18AF


# Arabic letters that never join the letter after them.
_ENDS_JOINING = "ءآأؤإاةدذرزوىٱ"


def _needed(text: str, i: int) -> bool:
    """Whether the joiner at ``i`` changes what is seen. Between Arabic letters a joiner does nothing where
    the letters join anyway, a non-joiner nothing where they do not."""
    before, after = text[i - 1 : i] if i else "", text[i + 1 : i + 2]
    if not (_shapes(before) and _shapes(after)):
        return False
    if "\u0620" <= before <= "\u064a" and "\u0620" <= after <= "\u064a":
        return (before in _ENDS_JOINING) == (text[i] == "\u200d")
    return True


def _pictured(c: str) -> bool:
    """Whether a selector behind this character may choose another picture of it: symbols, keycaps, ideographs and marks."""
    return not c or unicodedata.category(c)[0] not in "LZ" or unicodedata.name(c, "").startswith("CJK") or c in "\u2122\u2139"


def _canonical(segment: str) -> str:
    table = properties().table
    while True:
        # What composition or a rule has made may have a rule in its turn.
        out = unicodedata.normalize("NFC", segment.translate(table))
        if out == segment:
            return out
        segment = out


def canonical_form(text: str | None) -> str | None:
    """The form of a text; null stays null. Texts that look the same have the same form, and a form is its own form."""
    if text is None or text.isascii() and "\r" not in text:
        return text
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if _joiner.search(text) or _selector.search(text):
        whole = text = _invisible.sub("", text)  # so that a joiner stands beside what it joins
        text = _joiner.sub(lambda m: m[0] if _needed(whole, m.start()) else "", text)
        whole = text
        text = _selector.sub(lambda m: m[0] if _pictured(whole[m.start() - 1 : m.start()]) else "", text)
    if _tags.search(text):
        text = _tags.sub(lambda m: m[0] if m[1] else "", text)
    return properties().segment.sub(lambda m: _canonical(m[0]), text)


_blank = re.compile(r"^[\s\x00-\x1f\x7f-\x9f]*$")


def canonical(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, form, visible)`` of every row: the canonical form (null for null) and whether a
    character can be seen. Repeated rows come out repeated, other columns are not read, an empty
    table gives an empty one; texts are taken whole. No shuffle."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in by_bytes(batch, 1)):
            forms = [canonical_form(t) for t in b.column(1).to_pylist()]
            seen = [bool(f) and not _blank.match(f) for f in forms]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(forms, pa.string()), pa.array(seen, pa.bool_())], ["k", "form", "visible"])

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, form string, visible boolean").withColumnRenamed("k", key)


def _digests(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, f, t)``: 128-bit digests of form and text, of texts with a visible character."""
    import hashlib

    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in by_bytes(batch, 1)):
            keys, fs, ts = [], [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                form = canonical_form(t)
                if form and not _blank.match(form):
                    keys.append(k)
                    fs.append(hashlib.blake2b(form.encode("utf-8", "surrogatepass"), digest_size=16).digest())
                    ts.append(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(0).type), pa.array(fs, pa.binary()), pa.array(ts, pa.binary())], ["k", "f", "t"])

    return df.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("x")).mapInArrow(run, f"k {kind}, f binary, t binary")


BLOCK = 4_000
"""Rows of a form that one task compares with as many others."""


def lookalike_groups(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(form, writing, key, first_of_form, first_of_writing, n)``: the rows whose form is written in several ways.

    ``form`` and ``writing`` are digests, ``first_of_...`` the smallest keys with them, ``n`` how many rows have the form.
    One row a row: forms that all rows write in one way (exact copies) are left out however many they are, and no pair is
    made. What moves are digests and keys. Null keys and texts without a visible character have no row.
    """
    d = cut(_digests(df, key, text), "digests").df
    # Ways of writing of each form: copies are brought together in each task first.
    ways = d.groupBy("f").agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.min("k").alias("first_of_form"), F.count(F.lit(1)).alias("n"))
    ways = ways.where(F.col("lo") != F.col("hi")).drop("lo", "hi")
    rows = d.join(ways, "f")
    firsts = rows.groupBy("f", "t").agg(F.min("k").alias("first_of_writing"))
    return rows.join(firsts, ["f", "t"]).select(F.col("f").alias("form"), F.col("t").alias("writing"), F.col("k").alias(key), "first_of_form", "first_of_writing", "n")


def lookalike_pairs(df: DataFrame, key: str, text: str, block: int = BLOCK) -> DataFrame:
    """``(a, b)``, smaller key first: rows whose texts are different strings of one form, each pair once, also for
    repeated keys.

    These are the pairs asked for; where membership is enough, ``lookalike_groups`` is as long as its table. A form of many
    rows is cut into blocks, so that no task makes more than ``block`` squared of them.
    """
    d = cut(_digests(df, key, text), "digests").df
    ways = d.groupBy("f").agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count(F.lit(1)).alias("n")).where(F.col("lo") != F.col("hi"))
    rows = d.join(ways.select("f", F.ceil(F.col("n") / block).cast("int").alias("cuts")), "f")
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("k"), F.col("cuts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    a = rows.select("f", F.col("slice").alias("i"), F.col("other").alias("j"), F.col("k").alias("a"), F.col("t").alias("ta"))
    b = rows.select("f", F.col("other").alias("i"), F.col("slice").alias("j"), F.col("k").alias("b"), F.col("t").alias("tb"))
    return a.join(b, ["f", "i", "j"]).where((F.col("a") < F.col("b")) & (F.col("ta") != F.col("tb"))).select("a", "b").distinct()
