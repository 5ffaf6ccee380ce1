"""Encoding by a byte-level pair-merging vocabulary, over whole batches of distinct words.

The ranks of a public vocabulary file say which pair of neighbouring pieces merges first. All
distinct words of a batch that are not known yet lie one behind the other in flat arrays. An
index maps each rankable pair to all its positions in the batch; active ranks are applied in
ascending order, each to all its positions at once, and only the lists of the pairs beside a
merge change. A pair made by a merge always ranks behind that merge, so one ascending sweep is
enough and equals merging each word for itself.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import by_bytes, tokenizer_dir

# Fixed value: the public word pattern of the 50k byte-level vocabularies.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

MAX_CACHED_WORDS = 400_000
"""Bound of a worker's cache of encoded words; it is emptied when full, results do not depend on it."""


class PairIndexEncoder:
    """Encodes texts by a ``.tiktoken`` rank file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = {r: b for b, r in self.ranks.items()}
        self.first = [self.ranks[bytes([b])] for b in range(256)]
        self.pair_rank: dict[tuple[int, int], int] = {}
        self.split = regex.compile(WORD_PATTERN).findall
        self.words: dict[str, list[int]] = {}

    def _rank(self, pair: tuple[int, int]) -> int:
        """The id that a pair of ids merges into, or -1."""
        r = self.pair_rank.get(pair)
        if r is None:
            r = self.ranks.get(self.bytes_of[pair[0]] + self.bytes_of[pair[1]], -1)
            if len(self.pair_rank) > 2_000_000:
                self.pair_rank.clear()
            self.pair_rank[pair] = r
        return r

    def _learn(self, new: list[str]) -> None:
        """Encode words that are not in the cache, all together."""
        ids: list[int] = []
        starts: list[int] = []
        first = self.first
        for w in new:
            starts.append(len(ids))
            ids.extend([first[b] for b in w.encode("utf-8", "replace")])
        end = len(ids)
        nxt = list(range(1, end + 1))
        prv = list(range(-1, end - 1))
        for s in starts:
            prv[s] = -1
            if s:
                nxt[s - 1] = end
        if end:
            nxt[end - 1] = end
        # The occurrence index: merged id -> {pair: positions of the pair's left piece}.
        where: dict[tuple[int, int], list[int]] = {}
        for i in range(end):
            j = nxt[i]
            if j < end:
                where.setdefault((ids[i], ids[j]), []).append(i)
        active: list[int] = []
        pairs_of: dict[int, list[tuple[int, int]]] = {}
        rank = self._rank

        def activate(pair: tuple[int, int]) -> bool:
            r = rank(pair)
            if r < 0:
                return False
            known = pairs_of.get(r)
            if known is None:
                pairs_of[r] = [pair]
                heapq.heappush(active, r)
            else:
                known.append(pair)
            return True

        for pair in list(where):
            if not activate(pair):
                del where[pair]
        while active:
            merged = heapq.heappop(active)
            todo = []
            for pair in pairs_of.pop(merged):
                todo.extend((i, pair) for i in where.pop(pair, ()))
            todo.sort()  # the leftmost of overlapping places first
            for i, (a, b) in todo:
                j = nxt[i]
                if ids[i] != a or j >= end or ids[j] != b:
                    continue  # an earlier merge took one of the two
                ids[i], ids[j] = merged, -1
                k = nxt[i] = nxt[j]
                if k < end:
                    prv[k] = i
                    pair = (merged, ids[k])
                    at = where.get(pair)
                    if at is not None:
                        at.append(i)
                    elif activate(pair):
                        where[pair] = [i]
                h = prv[i]
                if h >= 0:
                    pair = (ids[h], merged)
                    at = where.get(pair)
                    if at is not None:
                        at.append(h)
                    elif activate(pair):
                        where[pair] = [h]
        words = self.words
        for n, w in enumerate(new):
            s, e = starts[n], starts[n + 1] if n + 1 < len(starts) else end
            words[w] = [x for x in ids[s:e] if x >= 0]

    def encode_all(self, texts: list[str | None]) -> list[list[int]]:
        """Token ids of each text; a null or empty text has none. Special strings are ordinary text."""
        if len(self.words) > MAX_CACHED_WORDS:
            self.words.clear()
        split, words = self.split, self.words
        parts = [split(t) if t else [] for t in texts]
        new = {w for p in parts for w in p if w not in words}
        if new:
            self._learn(list(new))
        out = []
        for p in parts:
            ids: list[int] = []
            for w in p:
                ids += words[w]
            out.append(ids)
        return out


_encoders: dict[str, PairIndexEncoder] = {}


def encoder(path: str) -> PairIndexEncoder:
    if path not in _encoders:
        _encoders[path] = PairIndexEncoder(path)
    return _encoders[path]


def vocabulary(name: str = "byte_bpe_50k") -> str:
    return os.path.join(tokenizer_dir(), f"{name}.tiktoken")


def encode(df: DataFrame, text: str, key: str, vocab: str | None = None, counts_only: bool = False) -> DataFrame:
    """``(key, ids)`` or, with ``counts_only``, ``(key, n_tokens)`` of every row.

    Null and empty texts have an empty list (0). Only the two named columns are read, so other
    columns of any name do not matter; repeated rows come out repeated; an empty table gives an
    empty table. No shuffle: each partition is encoded where it lies. Texts of any length are
    taken whole.
    """
    path = vocab or vocabulary()
    kind = df.schema[key].dataType.simpleString()
    schema = f"k {kind}, n_tokens bigint" if counts_only else f"k {kind}, ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in (part for batch in batches for part in by_bytes(batch, 1)):
            ids = enc.encode_all(b.column(1).to_pylist())
            v = pa.array([len(x) for x in ids], pa.int64()) if counts_only else pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), v], ["k", "n_tokens" if counts_only else "ids"])

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, schema).withColumnRenamed("k", key)
