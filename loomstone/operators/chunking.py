"""Token windows with overlap that end at sentence ends, and a provider boundary for embeddings."""

from __future__ import annotations

import base64
import hashlib
import os
import re
import time
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.functions.text import SPACE

TARGET, OVERLAP, MOST = 650, 100, 800

_BLANKS = re.compile(SPACE + "+")
_SENTENCE_END = re.compile(r"[.!?]+|[\n\r]+")

Tokenizer = Callable[[str], list[bytes]]
"""``text -> the bytes of its tokens``, which tile the text."""

_loaded: dict[str, tiktoken.Encoding] = {}


def byte_pair_tokens(vocabulary: str, pattern: str) -> Tokenizer:
    """Tokens by a public rank file, special strings as ordinary text; loaded once a worker."""

    def tokens(text: str) -> list[bytes]:
        e = _loaded.get(vocabulary)
        if e is None:
            with open(vocabulary, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
            e = _loaded[vocabulary] = tiktoken.Encoding(vocabulary, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return e.decode_tokens_bytes(e.encode_ordinary(text))

    return tokens


# Fixed value: the public word pattern of the 50k byte-level vocabularies.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_tokenizer() -> Tokenizer:
    return byte_pair_tokens(os.path.join(os.environ.get("LOOMSTONE_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.tiktoken"), WORD_PATTERN)


def windows(text: str, target: int = TARGET, overlap: int = OVERLAP, most: int = MOST, tokenizer: Tokenizer | None = None) -> list[tuple[int, int, str]]:
    """``(start_token, end_token, text)`` of each window, in tokens of the tokenizer (``byte_bpe_50k``).

    A text of at most ``target`` tokens is one window. Else a window ends at the sentence end nearest
    to ``target`` (the first of equals) between ``target - overlap`` and ``most`` tokens, or at
    ``target``; once at most ``most`` tokens are left they are the last window. The next window begins
    ``overlap`` tokens before the end. Only sentence ends at a token's edge count. A window that begins or ends
    inside a character shows the replacement character there.
    """
    if target <= 0 or not 0 <= overlap < target or most < target:
        raise ValueError("0 < target, 0 <= overlap < target <= most")
    if not text:
        return []
    raw = text.encode("utf-8", "replace")
    text = raw.decode("utf-8")
    tokens = (tokenizer or default_tokenizer())(text)
    n = len(tokens)
    if n <= target:
        return [(0, n, text)]
    ends = np.cumsum([len(t) for t in tokens])
    at = np.concatenate([[0], ends])
    chars = None
    if len(raw) != len(text):
        c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        chars = np.cumsum(1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000))
    edges = np.array([m.end() for m in _SENTENCE_END.finditer(text) if m.end() < len(text)], np.int64)
    if chars is not None and len(edges):
        edges = chars[edges - 1]
    stops = (np.nonzero(np.isin(ends, edges))[0] + 1).tolist()
    out, start = [], 0
    while True:
        if n - start <= most:
            out.append((start, n, raw[at[start] :].decode("utf-8", "replace")))
            return out
        lo, hi, aim = start + target - overlap, start + most, start + target
        near = stops[bisect_left(stops, lo) : bisect_right(stops, hi)]
        best = min(near, key=lambda s: (abs(s - aim), s), default=aim)
        end = best if best - overlap > start else aim
        out.append((start, end, raw[at[start] : at[end]].decode("utf-8", "replace")))
        start = end - overlap


def chunks(df: DataFrame, key: str, text: str, target: int = TARGET, overlap: int = OVERLAP, most: int = MOST) -> DataFrame:
    """``(key, chunk_index, start_token, end_token, token_count, text)``. Null and empty texts have none."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, s, e, e - s, t) for k, x in zip(b["k"], b["t"]) if x for i, (s, e, t) in enumerate(windows(x, target, overlap, most))]
            yield pd.DataFrame(rows, columns=["k", "chunk_index", "start_token", "end_token", "token_count", "text"])

    out = df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, chunk_index int, start_token int, end_token int, token_count int, text string")
    return out.withColumnRenamed("k", key)


def hashing_embedder(texts: list[str], dim: int = 64) -> np.ndarray:
    """The local default of an embedding provider: signed hashed small words, unit length. A word's MD5 gives its
    place (first eight digits) and its sign (plus for an even ninth digit)."""
    out = np.zeros((len(texts), dim), np.float64)
    for i, t in enumerate(texts):
        for w in _BLANKS.split(t.lower()):
            if w:
                h = hashlib.md5(w.encode("utf-8", "replace"), usedforsecurity=False).hexdigest()
                out[i, int(h[:8], 16) % dim] += 1 if h[8] in "02468ace" else -1
        n = np.linalg.norm(out[i])
        if n:
            out[i] /= n
    return out


def with_attempts(provider: Callable[[list[str]], np.ndarray], attempts: int, base_ms: int) -> Callable[[list[str]], np.ndarray]:
    """The provider, called again where it fails."""

    def call(texts: list[str]) -> np.ndarray:
        for n in range(attempts - 1):
            try:
                return provider(texts)
            except Exception:
                time.sleep(base_ms * 2**n / 1000)
        return provider(texts)

    return call


def embed(c: Column, provider: Callable[[list[str]], np.ndarray] = hashing_embedder, batch: int = 100, attempts: int = 3, base_ms: int = 500) -> Column:
    """Vectors of texts, in batches of ``batch`` a call; null for null or empty text. A call that fails is made
    again, ``attempts`` times in all, after ``base_ms`` doubled each time; then the failure is the task's."""

    call = with_attempts(provider, attempts, base_ms)

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out: list = [None] * len(s)
            todo = [i for i, t in enumerate(s) if t]
            for lo in range(0, len(todo), batch):
                part = todo[lo : lo + batch]
                for i, v in zip(part, call([s.iloc[i] for i in part])):
                    out[i] = v.tolist()
            yield pd.Series(out)

    return run(c)
