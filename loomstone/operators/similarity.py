"""Exact joins of vectors above a cosine, and clusters from them.

Vectors are laid along the direction in which a sample is widest and cut into slices of bounded size.
Unit vectors whose cosine is above t lie within sqrt(2 - 2t) of each other, and so do their places on the line:
slices farther apart never meet. The pairs of slices that are left are multiplied as blocks. Each row finds its
blocks for itself; the driver sees the slices' bounds only. Nothing is approximate: the result is that of comparing
all pairs, and where the bound prunes nothing the work is that of all pairs, in blocks. For collections
beyond some millions of vectors an index, which loses a little, is the better operator.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.session import ship
from loomstone.storage import cut

SLICE = 8_000
"""Rows of a slice, about; a block is two slices."""
FEW = 500
"""Small tables are cut into slices of so many rows, at most eight, so that cores share the work."""
SAMPLE = 2_000
"""Rows that decide the direction; they change the pruning, not the result."""


def _unit(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def links(df: DataFrame, key: str, vector: str, min_cosine: float) -> DataFrame:
    """``(a, b, cosine)``, a < b: pairs of rows whose cosine is above ``min_cosine`` (strictly).

    Float values, sums in double. Null keys and null or empty vectors are left out; a vector of
    zeros has no pair; vectors of different lengths are an error. Repeated keys are one row. The
    pairs are what was asked for; where a group of n alike vectors is large, use ``link_counts``, which
    gives one row per vector.
    """
    return _blocks(df, key, vector, min_cosine, "pairs")


def link_counts(df: DataFrame, key: str, vector: str, min_cosine: float) -> DataFrame:
    """``(key, n_links)`` of every row that has a pair: how many, without the pairs."""
    part = _blocks(df, key, vector, min_cosine, "counts")
    return part.groupBy("a").agg(F.sum("n").alias("n_links")).select(F.col("a").alias(key), "n_links")


def _direction(rows: DataFrame) -> np.ndarray | None:
    chosen = rows.orderBy(F.xxhash64("k")).limit(SAMPLE).select("v").collect()  # bounded
    if not chosen:
        return None
    x = _unit([r.v for r in chosen])
    return np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][0]


def _blocks(df: DataFrame, key: str, vector: str, min_cosine: float, what: str, size: int = SLICE) -> DataFrame:
    """``what``: all pairs, or the counts of each row, or ties, which join in each block what pairs join."""
    spark = df.sparkSession
    ship(spark)
    rows = df.where(F.col(key).isNotNull() & (F.size(vector) > 0)).groupBy(F.col(key).alias("k")).agg(F.max(vector).alias("v"))
    rows = cut(rows, "vectors").df
    kind = rows.schema["k"].dataType.simpleString()
    out_schema = {"pairs": f"a {kind}, b {kind}, cosine double", "counts": f"a {kind}, n bigint", "ties": f"a {kind}, b {kind}"}[what]
    n = rows.count()
    direction = _direction(rows)
    if direction is None:
        return spark.createDataFrame([], out_schema)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"p": _unit(b["v"]) @ direction if len(b) else np.zeros(0)})

    slices = max(math.ceil(n / size), min(8, math.ceil(n / FEW)))
    inner = rows.select("v").mapInPandas(project, "p double").approxQuantile("p", [i / slices for i in range(1, slices)], 1 / (20 * slices)) if slices > 1 else []
    bounds = np.array(sorted(inner))
    low, high = np.r_[-np.inf, bounds], np.r_[bounds, np.inf]
    reach = math.sqrt(max(0.0, 2 - 2 * max(-1.0, min(1.0, min_cosine)))) + 1e-9
    # Slice i meets the slices first[i] to last[i]; bounds are in order, so these are neighbours.
    first, last = np.searchsorted(high, low - reach, "left"), np.searchsorted(low, high + reach, "right") - 1

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = _unit(b["v"]) @ direction if len(b) else np.zeros(0)
            a, z = np.searchsorted(bounds, x, "left"), np.searchsorted(bounds, x, "right")
            # One place on the line may hold many rows and so several bounds: its rows spread over these slices.
            at = a + b["salt"].to_numpy() % (z - a + 1)
            yield pd.DataFrame({"k": b["k"], "v": b["v"], "slice": at.astype(np.int32), "first": first[at].astype(np.int32), "last": last[at].astype(np.int32)})

    salted = rows.select("k", "v", F.pmod(F.xxhash64("k"), F.lit(1 << 30)).cast("int").alias("salt"))
    routed = salted.mapInPandas(route, f"k {kind}, v array<float>, slice int, first int, last int")
    met = routed.select("k", "v", "slice", F.explode(F.sequence("first", "last")).alias("other"))
    sent = met.select("k", "v", F.least("slice", "other").alias("i"), F.greatest("slice", "other").alias("j"), (F.col("slice") > F.col("other")).alias("right"))

    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        same = pdf["i"].iloc[0] == pdf["j"].iloc[0]
        left, right = (pdf, pdf) if same else (pdf[~pdf["right"]], pdf[pdf["right"]])
        nothing = {"pairs": {"a": [], "b": [], "cosine": []}, "counts": {"a": [], "n": []}, "ties": {"a": [], "b": []}}[what]
        if not len(left) or not len(right):
            return pd.DataFrame(nothing)
        ka, kb = left["k"].to_numpy(), right["k"].to_numpy()
        x, y = _unit(left["v"]), _unit(right["v"]).T
        parts = []
        for lo in range(0, len(x), 512):  # a strip of the block at a time
            cos = x[lo : lo + 512] @ y
            i, j = np.nonzero(cos > min_cosine)
            c = cos[i, j]
            i = i + lo
            ok = ka[i] < kb[j] if same else ka[i] != kb[j]
            parts.append((i[ok], j[ok], c[ok]))
        i, j, c = (np.concatenate(z) for z in zip(*parts))
        if what == "pairs":
            return pd.DataFrame({"a": np.where(ka[i] < kb[j], ka[i], kb[j]), "b": np.where(ka[i] < kb[j], kb[j], ka[i]), "cosine": c})
        if what == "counts":
            met = pd.concat([pd.Series(ka[i]), pd.Series(kb[j])]).value_counts()
            return pd.DataFrame({"a": met.index, "n": met.to_numpy()})
        names, at = np.unique(np.concatenate([ka, kb]), return_inverse=True)  # in order, so the smallest is the first
        a, b = at[i], at[len(ka) + j]
        low = _smallest(len(names), a, b)
        tied = np.nonzero(low != np.arange(len(names)))[0]
        return pd.DataFrame({"a": names[low[tied]], "b": names[tied]})

    return sent.groupBy("i", "j").applyInPandas(multiply, out_schema)


FEW_EDGES = 200_000
"""So many edges are joined in one task; more take rounds over the cluster."""


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)``: the smallest node each node is joined to, directly or through others.

    Alternating large and small stars until only stars are left: about as many rounds as the logarithm
    of the longest path; a round's table is written, so lineage stays short and a lost executor repeats one round at most.
    At most ``FEW_EDGES`` edges are joined in one task instead, with the same result.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    table = cut(e, "edges")
    if table.df.count() <= FEW_EDGES:
        return _joined_at_once(table.df)
    while not _stars(table.df):
        e = table.df
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        pair = F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        new = cut(large.join(low2, "u").select(F.explode(pair).alias("x")).select("x.u", "x.v").where("u != v").distinct(), "edges")
        table.drop()
        table = new
    e = table.df
    roots = e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _joined_at_once(e: DataFrame) -> DataFrame:
    kind = e.schema["u"].dataType.simpleString()
    ship(e.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if parts:
            pairs = pd.concat(parts)
            names, at = np.unique(np.concatenate([pairs["u"].to_numpy(), pairs["v"].to_numpy()]), return_inverse=True)
            yield pd.DataFrame({"node": names, "root": names[_smallest(len(names), at[: len(pairs)], at[len(pairs) :])]})

    return e.coalesce(1).mapInPandas(run, f"node {kind}, root {kind}")


def _smallest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each of the nodes ``0..n-1`` the smallest that the edges ``(a, b)`` join it to."""
    low = np.arange(n)
    while True:
        before = low.copy()
        # Edges between roots: the greater root hangs on the smaller one, then paths are halved.
        x, y = low[a], low[b]
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while not (low[low] == low).all():
            low = low[low]
        if (low == before).all():
            return low


def _stars(e: DataFrame) -> bool:
    """Whether every node hangs on one root that hangs on none."""
    ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("below")), F.struct(F.col("v").alias("node"), F.lit(0).alias("below")))).alias("x")).select("x.*")
    # A node that stands below another, and more than once, is no leaf of a star.
    bad = ends.groupBy("node").agg(F.sum("below").alias("n"), F.min("below").alias("root")).where((F.col("n") > 1) | (F.col("n") == 1) & (F.col("root") == 0))
    return bad.limit(1).count() == 0


def clusters(df: DataFrame, key: str, vector: str, min_cosine: float, least: int = 3) -> DataFrame:
    """``(cluster_id, key, n)`` of the members of every component of ``least`` or more rows."""
    c = components(_blocks(df, key, vector, min_cosine, "ties"))
    sizes = c.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return c.join(sizes, "root").select(F.col("root").alias("cluster_id"), F.col("node").alias(key), "n")


def scored(members: DataFrame, ts: str, now) -> DataFrame:
    """Clusters with size, mean age and score, ranked: size plus the share of 30 days that the mean age
    leaves, ties by the smallest id."""
    age = (F.unix_micros(now) - F.unix_micros(F.col(ts))) / F.lit(86_400_000_000.0)
    s = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_signals"), F.avg(age).alias("avg_age_days"))
    s = s.withColumn("score", F.col("n_signals") + F.greatest(F.lit(0.0), F.lit(30.0) - F.col("avg_age_days")) / 30)
    w = Window.orderBy(F.desc("score"), "cluster_id")  # one row per cluster
    return s.withColumn("rank", F.row_number().over(w))
