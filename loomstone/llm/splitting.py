"""Splitting oversized texts at natural boundaries, by recursive bisection.

A text above the limit is cut at the strongest boundary near its middle (paragraph, line,
sentence, clause, word, and only where there is none of these, between two characters); each
half that is still above the limit less the room for the overlap is cut again. Then each piece
but the first is given the last words of the one before as overlap, or its last characters where no
word begins in the room for it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import by_bytes

MAX_WORDS, MAX_CHARS, OVERLAP_WORDS, OVERLAP_CHARS = 800, 6_000, 100, 750

WORD = re.compile(r"[^ \t\r\n]+")
WORD_JVM = r"[^ \t\r\n]+"

# Boundaries, the strongest first; a cut lies at the end of the match.
BOUNDARIES = [
    re.compile(r"\n[ \t\r]*\n\s*"),
    re.compile(r"\n"),
    re.compile(r"[.!?…]+[\"')\]]*\s+|[。！？]+"),
    re.compile(r"[;:,]\s+|[、；：，]"),
    re.compile(r"\s+"),
]


def is_oversized(text, max_words: int = MAX_WORDS, max_chars: int = MAX_CHARS):
    """A column: whether a text has more words or code points than the limits. Null: false."""
    n = F.coalesce(F.length(text), F.lit(0))
    # A text of so few code points cannot have so many words; the count is only made for the rest.
    words = F.when(n > 2 * max_words, F.regexp_count(text, F.lit(WORD_JVM))).otherwise(F.lit(0))
    return (n > max_chars) | (words > max_words)


def _cut_point(text: str, lo: int, hi: int) -> int:
    """Where to cut ``text[lo:hi]``: the strongest boundary in its middle part, the nearest to the middle."""
    mid, reach = (lo + hi) // 2, max(1, (hi - lo) // 5)
    a, b = max(lo + 1, mid - reach), min(hi - 1, mid + reach)
    for pattern in BOUNDARIES:
        best = -1
        for m in pattern.finditer(text, a, b):
            e = m.end()
            if lo < e < hi and (best < 0 or abs(e - mid) < abs(best - mid)):
                best = e
        if best > 0:
            return best
    return mid


def _within(text: str, at: int) -> bool:
    """Whether ``at`` lies inside a character: before a mark or joiner, behind a joiner, or between surrogates."""
    c = text[at]
    return unicodedata.combining(c) > 0 or unicodedata.category(c) in ("Mn", "Me", "Mc") or c == "\u200d" or text[at - 1] == "\u200d" or "\U0001f3fb" <= c <= "\U0001f3ff" or "\udc00" <= c <= "\udfff"


def bisect(text: str, max_words: int = MAX_WORDS, max_chars: int = MAX_CHARS, overlap_words: int = OVERLAP_WORDS, overlap_chars: int = OVERLAP_CHARS) -> list[tuple[int, int, int]]:
    """Pieces ``(start, own, end)``: ``text[own:end]`` are its own characters, which tile the text,
    ``text[start:own]`` repeats the last words of the piece before, or where none of them begins in the
    last ``overlap_chars`` code points, these code points, less those of a character begun before them."""
    starts = [m.start() for m in WORD.finditer(text)]

    def words(lo: int, hi: int) -> int:
        from bisect import bisect_left

        i, j = bisect_left(starts, lo), bisect_left(starts, hi)
        cut_word = lo < hi and lo > 0 and not text[lo].isspace() and not text[lo - 1].isspace()
        return j - i + (1 if cut_word else 0)

    if len(text) <= max_chars and len(starts) <= max_words:
        return [(0, 0, len(text))]
    room_w, room_c = max_words - overlap_words, max_chars - overlap_chars
    done: list[tuple[int, int]] = []
    todo = [(0, len(text))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= room_c and words(lo, hi) <= room_w:
            done.append((lo, hi))
            continue
        at = _cut_point(text, lo, hi)
        todo += [(at, hi), (lo, at)]
    out = [(0, *done[0])]
    for (lo, hi), (nlo, nhi) in zip(done, done[1:]):
        floor, start = max(lo, nlo - overlap_chars), nlo
        spans = [m.start() for m in WORD.finditer(text, floor, nlo)]
        if floor > 0 and spans and spans[0] == floor and not text[floor - 1].isspace() and floor > lo:
            spans = spans[1:]  # that word began before the overlap's room
        if spans:
            start = spans[max(0, len(spans) - overlap_words)]
        elif overlap_words > 0 and not text[floor:nlo].isspace():
            start = floor
            while lo < start < nlo and _within(text, start):
                start += 1
            if start == nlo:  # one character fills the room
                start = floor
        out.append((start, nlo, nhi))
    return out


def split(df: DataFrame, key: str, text: str, max_words: int = MAX_WORDS, max_chars: int = MAX_CHARS, overlap_words: int = OVERLAP_WORDS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """``(key, piece_no, n_pieces, start, own_start, end, n_words, piece)`` of every oversized text.

    Offsets are code points from 0. The limits hold for a piece with its overlap; the overlap is
    ``overlap_words`` words, fewer where they would be more than ``overlap_chars`` code points, and the last
    ``overlap_chars`` code points where no word begins in them.
    Texts within the limits, null and empty texts give no piece. Keys may be null or repeated: each
    row is split for itself. Other columns are not read. An empty table gives an empty table.
    Only oversized texts leave the JVM.
    """
    kind = df.schema[key].dataType.simpleString()
    schema = f"k {kind}, piece_no int, n_pieces int, start int, own_start int, `end` int, n_words int, piece string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["k", "piece_no", "n_pieces", "start", "own_start", "end", "n_words", "piece"]
        for b in (part for batch in batches for part in by_bytes(batch, 1)):
            cols: list[list] = [[] for _ in names]
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                pieces = bisect(t, max_words, max_chars, overlap_words, overlap_chars)
                for n, (s, own, e) in enumerate(pieces):
                    p = t[s:e]
                    for c, v in zip(cols, (k, n, len(pieces), s, own, e, len(WORD.findall(p)), p)):
                        c.append(v)
            types = [b.schema.field(0).type, *[pa.int32()] * 6, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    big = df.where(is_oversized(F.col(text), max_words, max_chars))
    return big.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, schema).withColumnRenamed("k", key)
