"""Most similar vectors by a forest of random-projection trees, and clusters of alike vectors.

Vectors are made unit and packed as 16-bit fixed point with a scale of their own (cosines are
right to about 1e-5). Exact copies are collapsed first and come back at the end, so a group of copies
of any size costs one vector. The trees are fitted on a bounded sample: each node splits at the
median along a random projection that two-means steps have turned to where the sample is widest.
Each vector walks all trees with one shared priority queue, ordered by how far it lies on the wrong
side of the splits, and visits the best leaves of the whole forest; candidates are reranked by their cosines.

Depth follows the collection's size, so that a leaf holds at most about ``LEAF`` vectors. The sample decides the
upper levels, as many as it can. Levels below them share one projection a level and tree, and each node has its
own median, found in a distributed pass over about ``DEEP`` vectors a leaf; these medians, one float a node, are all the driver sees.
Leaves that are neighbours in a tree share a bucket, to which a vector is sent once. The sample also tells how many
vectors will visit a bucket: beyond ``CROWD`` its visitors are spread over parts that each hold its members.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.llm.common import cut
from loomstone.operators.similarity import components

DIM = 128
SAMPLE = 49_152
"""At most about so many vectors fit the trees; every vector is indexed."""
LEAF = 1280
CROWD = 250_000
"""About so many visitors share a part of a bucket, some 70 MB; each part holds the bucket's members again."""
DEEP = 64
"""About so many vectors a leaf decide the medians of the levels below the sample's."""
TREES = 4
VISITS = 18
"""Leaves visited for alike vectors; neighbours that are hardly more alike than any other take ``FAR_VISITS``."""
FAR_VISITS = 32
SEED = 20


# --- packing -------------------------------------------------------------------------------


def pack(rows: np.ndarray) -> list[bytes]:
    """Unit vectors as bytes: a float32 scale, then int16 values."""
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    scale = np.abs(unit).max(axis=1) / 32767
    q = np.rint(unit / scale[:, None]).astype("<i2")
    s = scale.astype("<f4")
    return [a.tobytes() + b.tobytes() for a, b in zip(s, q)]


def unpack(packed, dim: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(packed), np.uint8).reshape(-1, 4 + 2 * dim)
    scale = raw[:, :4].copy().view("<f4")
    out = raw[:, 4:].copy().view("<i2").astype(np.float32)
    out *= scale
    out /= np.linalg.norm(out, axis=1, keepdims=True)
    return out


def _packed(col: pa.Array, dim: int) -> pa.Array:
    """Packed form of usable vectors: ``dim`` finite values, not all zero; null for the rest."""
    n = len(col)
    out: list[bytes | None] = [None] * n
    lengths = np.diff(np.asarray(col.offsets))
    ok = np.nonzero((lengths == dim) & np.asarray(col.is_valid()))[0]
    if len(ok):
        starts = np.asarray(col.offsets)[ok]
        flat = col.values.to_numpy(zero_copy_only=False).astype(np.float64)  # null values are nan
        rows = flat[starts[:, None] + np.arange(dim)]
        fine = np.isfinite(rows).all(axis=1) & (rows != 0).any(axis=1)
        rows, ok = rows[fine], ok[fine]
        big = np.abs(rows).max(axis=1, keepdims=True) if len(rows) else 1.0
        for i, b in zip(ok, pack(rows / big) if len(rows) else []):
            out[i] = b
    return pa.array(out, pa.binary())


class Vectors:
    """The usable vectors of a table: ``base`` ``(rid, id, h, q)``, one row per id; ``reps``, the rows of
    ``base`` of which no earlier row is a copy; ``copies`` ``(rep, member, ord)`` of vectors that occur
    more than once."""

    def __init__(self, signals: DataFrame, dim: int = DIM):
        self.dim = dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([*b.columns[:3], _packed(b.column(3), dim)], ["id", "ingested_at", "is_deleted", "q"])

        packed = signals.where(F.col("id").isNotNull()).select("id", "ingested_at", "is_deleted", "embedding")
        packed = packed.mapInArrow(run, "id string, ingested_at timestamp, is_deleted boolean, q binary")
        newest = packed.groupBy("id").agg(F.max(F.struct("ingested_at", "is_deleted", "q")).alias("m"))
        kept = newest.where(F.col("m.q").isNotNull() & ~F.coalesce("m.is_deleted", F.lit(False)))
        rows = kept.select(F.monotonically_increasing_id().alias("rid"), "id", F.md5("m.q").alias("h"), F.col("m.q").alias("q"))
        self.base_table = cut(rows, "vectors")
        self.base = self.base_table.df
        groups = self.base.groupBy("h").agg(F.min("rid").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "rep")
        members = self.base.select("rid", "id", "h").join(groups, "h").select("rep", F.col("rid").alias("member"), "id")
        self.copies = cut(members, "copies").df
        self.reps = self.base.select("rid", "q").join(self.copies.where("member != rep").select(F.col("member").alias("rid")), "rid", "left_anti")
        self.n = self.base.count()

    def copy_counts(self) -> DataFrame:
        """``(rep, n)``: how many rows hold each vector that occurs more than once."""
        return self.copies.groupBy("rep").agg(F.count(F.lit(1)).alias("n"))

    def first_copies(self, k: int) -> DataFrame:
        """``(rep, member, ord)`` of the first k copies of each vector by id."""
        w = Window.partitionBy("rep").orderBy("id")
        return self.copies.withColumn("ord", F.row_number().over(w)).where(F.col("ord") <= k).select("rep", "member", "ord")


# --- the forest ----------------------------------------------------------------------------


class Forest:
    """Trees as flat arrays of split planes, level by level; ``deep`` levels below them share a projection a level."""

    def __init__(self, sample: np.ndarray, n: int, trees: int, leaf: int, seed: int):
        dim = sample.shape[1]
        wanted = max(0, math.ceil(math.log2(max(1, n / leaf))))
        most = int(math.log2(max(1, len(sample) // 32))) if len(sample) else 0
        self.top = min(wanted, most)
        self.deep = wanted - self.top if self.top else 0
        self.depth = self.top + self.deep
        self.trees = trees if self.depth else 1
        nodes = 2**self.top - 1
        self.planes = np.zeros((self.trees, nodes, dim), np.float32)
        self.at = np.zeros((self.trees, nodes), np.float32)
        self.deep_planes = np.zeros((self.trees, self.deep, dim), np.float32)
        # Of each tree and top leaf the medians of its nodes, level by level.
        self.deep_at = np.zeros((self.trees, 2**self.top, max(0, 2**self.deep - 1)), np.float32)
        self.bucket_shift = min(self.depth, 4)
        for t in range(self.trees):
            rng = np.random.default_rng(seed + t)
            groups = [np.arange(len(sample))]
            node = 0
            for _ in range(self.top):
                split = []
                for g in groups:
                    v = self._projection(sample, g, rng)
                    p = sample[g] @ v
                    m = np.median(p) if len(g) else np.float32(0)
                    self.planes[t, node], self.at[t, node] = v, m
                    node += 1
                    split += [g[p <= m], g[p > m]]
                groups = split
            for level in range(self.deep):
                self.deep_planes[t, level] = self._projection(sample, rng.choice(len(sample), min(len(sample), 64), replace=False), rng)
        self.parts = np.ones(self.trees * 2 ** (self.depth - self.bucket_shift), np.int64)

    @staticmethod
    def _projection(sample: np.ndarray, g: np.ndarray, rng) -> np.ndarray:
        v = rng.standard_normal(sample.shape[1]).astype(np.float32)
        if len(g) >= 4:
            y = sample[g if len(g) <= 2000 else rng.choice(g, 2000, replace=False)]
            a, b = rng.choice(len(y), 2, replace=False)
            c0, c1 = y[a], y[b]
            for _ in range(4):
                side = y @ (c0 - c1) > (c0 @ c0 - c1 @ c1) / 2
                if side.all() or not side.any():
                    break
                c0, c1 = y[side].mean(axis=0), y[~side].mean(axis=0)
            if np.any(c0 != c1):
                v = c0 - c1
        return (v / np.linalg.norm(v)).astype(np.float32)

    def top_leaves(self, x: np.ndarray, tree: int) -> np.ndarray:
        """The leaf of the sample's levels in which each vector lies."""
        node = np.zeros(len(x), np.int64)
        margin = x @ self.planes[tree].T - self.at[tree]
        for level in range(self.top):
            node = 2 * node + (margin[np.arange(len(x)), node + 2**level - 1] > 0)
        return node

    def medians(self, projected: np.ndarray) -> np.ndarray:
        """The medians of a top leaf's deep nodes from the projections ``(vectors, deep)`` of some of its vectors."""
        out = np.zeros(2**self.deep - 1, np.float32)
        groups, node = [np.arange(len(projected))], 0
        for level in range(self.deep):
            split = []
            for g in groups:
                p = projected[g, level]
                out[node] = np.median(p) if len(g) else 0
                split += [g[p <= out[node]], g[p > out[node]]]
                node += 1
            groups = split
        return out

    def visits(self, x: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(row, leaf, own)`` of the leaves visited: leaves count through all trees; ``own`` marks the
        leaf of each tree in which the vector lies."""
        m, d = len(x), self.depth
        if d == 0:
            return np.arange(m), np.zeros(m, np.int64), np.ones(m, bool)
        leaves, costs = [], []
        for t in range(self.trees):
            margin = x @ self.planes[t].T
            margin -= self.at[t]
            far = x @ self.deep_planes[t].T
            node = np.zeros((m, 1), np.int64)
            cost = np.zeros((m, 1), np.float32)
            for level in range(d):
                if level < self.top:
                    g = np.take_along_axis(margin, node + (2**level - 1), 1)
                else:
                    k = level - self.top
                    g = far[:, k : k + 1] - self.deep_at[t, node >> k, (node & (2**k - 1)) + 2**k - 1]
                low, high = np.where(g <= 0, cost, np.maximum(cost, g)), np.where(g > 0, cost, np.maximum(cost, -g))
                # The vector's own branch costs nothing more; g > 0 lies on the right.
                node = np.concatenate([2 * node, 2 * node + 1], 1)
                cost = np.concatenate([low, high], 1)
                if node.shape[1] > count:
                    best = np.argpartition(cost, count - 1, axis=1)[:, :count]
                    node, cost = np.take_along_axis(node, best, 1), np.take_along_axis(cost, best, 1)
            leaves.append(node + t * 2**d)
            costs.append(cost)
        leaf, cost = np.concatenate(leaves, 1), np.concatenate(costs, 1)
        if leaf.shape[1] > count:  # the shared queue: the best of all trees
            best = np.argpartition(cost, count - 1, axis=1)[:, :count]
            leaf, cost = np.take_along_axis(leaf, best, 1), np.take_along_axis(cost, best, 1)
        row = np.repeat(np.arange(m), leaf.shape[1])
        return row, leaf.ravel(), (cost <= 0).ravel()


def _fit(v: Vectors, sample: int, trees: int, leaf: int, visits: int, seed: int) -> Forest:
    share = min(1.0, sample / max(v.n, 1))
    chosen = _some(v.reps, share, seed)
    q = [bytes(r[0]) for r in chosen.select("q").limit(2 * sample).toLocalIterator()] if v.n else []
    x = unpack(q, v.dim) if q else np.zeros((0, v.dim), np.float32)
    forest = Forest(x, v.n, trees, leaf, seed)
    if forest.deep:
        _fit_deep(v, forest, leaf, seed)
    if forest.depth and len(x):
        some = x[:8192]
        row, at, own = forest.visits(some, visits)
        pairs = np.unique(np.stack([row, at >> forest.bucket_shift]), axis=1)[1]
        crowd = np.bincount(pairs, minlength=len(forest.parts)) * (v.n / len(some))
        forest.parts = np.maximum(1, np.ceil(crowd / CROWD)).astype(np.int64)
    return forest


def _some(reps: DataFrame, share: float, seed: int) -> DataFrame:
    return reps.where(F.pmod(F.xxhash64("rid", F.lit(seed)), F.lit(1 << 40)) < int(share * (1 << 40))) if share < 1 else reps


def _fit_deep(v: Vectors, forest: Forest, leaf: int, seed: int) -> None:
    """The medians of the levels below the sample's: of some vectors of every top leaf only their projections move."""
    dim, deep = v.dim, forest.deep
    shared = v.reps.sparkSession.sparkContext.broadcast(forest)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for b in batches:
            x = unpack(b.column(0).to_pylist(), dim) if b.num_rows else np.zeros((0, dim), np.float32)
            for t in range(f.trees):
                p = (x @ f.deep_planes[t].T).astype(np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * deep), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(f.top_leaves(x, t).astype(np.int32)), lists], ["tree", "leaf", "p"])

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        at = shared.value.medians(np.stack(pdf["p"].to_list()))
        return pd.DataFrame({"tree": [pdf["tree"].iloc[0]], "leaf": [pdf["leaf"].iloc[0]], "at": [at]})

    some = _some(v.reps, min(1.0, DEEP / leaf), seed + 1).select("q")
    rows = some.mapInArrow(project, "tree int, leaf int, p array<float>").groupBy("tree", "leaf").applyInPandas(settle, "tree int, leaf int, at array<float>")
    for r in rows.toLocalIterator():  # one float a node: n / leaf floats a tree
        forest.deep_at[r.tree, r.leaf] = r["at"]


def _visits(v: Vectors, forest: Forest, count: int, weighted: bool = False) -> DataFrame:
    """``(bucket, rid, q, leaves)``: each vector once per bucket it visits, and once per part of a bucket it lies in; in
    ``leaves`` the lowest bit marks a leaf the vector lies in, the one above it that it is no visitor of this part.
    ``weighted`` adds ``w``, how many copies the vector stands for."""
    dim = v.dim
    reps = v.reps
    if weighted:
        reps = reps.join(v.copy_counts().withColumnRenamed("rep", "rid"), "rid", "left").select("rid", "q", F.coalesce("n", F.lit(1)).alias("w"))
    shared = v.reps.sparkSession.sparkContext.broadcast(forest)  # planes bounded by the sample, and a float a deep node
    first_part = np.r_[0, np.cumsum(forest.parts)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                q, rid = part.column(1), np.asarray(part.column(0))
                row, leaf, own = f.visits(unpack(q.to_pylist(), dim), count)
                bucket = leaf >> f.bucket_shift
                order = np.lexsort((leaf, bucket, row))
                row, leaf, own, bucket = row[order], leaf[order], own[order], bucket[order]
                first = np.nonzero(np.r_[True, (row[1:] != row[:-1]) | (bucket[1:] != bucket[:-1])])[0]
                size = np.diff(np.r_[first, len(row)])
                # A visitor goes to one part of a bucket, a member to all of them.
                parts = f.parts[bucket[first]]
                home = (rid[row[first]] * 2654435761 >> 7) % parts
                member = np.add.reduceat(own, first) > 0
                copies = np.where(member, parts, 1)
                of = np.repeat(np.arange(len(first)), copies)
                nth = np.arange(len(of)) - np.repeat(np.cumsum(copies) - copies, copies)
                to = np.where(member[of], nth, home[of])
                guest = to == home[of]
                take = np.concatenate([np.arange(first[i], first[i] + size[i]) for i in of]) if (copies > 1).any() else np.arange(len(row))
                lens = size[of]
                # Outside its home part a member is there to be found, not to search.
                code = (leaf[take] * 4 + 2 * np.repeat(~guest, lens) + own[take]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lens)].astype(np.int32)), pa.array(code))
                at = pa.array(row[first][of])
                key = first_part[bucket[first][of]] + to
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), part.column(0).take(at), q.take(at), lists, *([part.column(2).take(at)] if weighted else [])], ["bucket", "rid", "q", "leaves", *(["w"] if weighted else [])])

    # Partitions are the session's: copies of a vector that go to one of them compress to little more than one.
    return reps.mapInArrow(run, "bucket int, rid bigint, q binary, leaves array<int>" + ", w bigint" * weighted)


def _leaf_blocks(pdf: pd.DataFrame, dim: int):
    """``(queries, members, cosines)`` of each leaf of a bucket, as row numbers of ``pdf``; in blocks of
    queries, so that the memory of a leaf is bounded."""
    x = unpack(pdf["q"].tolist(), dim)
    counts = pdf["leaves"].map(len).to_numpy()
    row = np.repeat(np.arange(len(pdf)), counts)
    code = np.concatenate(pdf["leaves"].tolist())
    leaf, searches, own = code >> 2, (code & 2) == 0, (code & 1) == 1
    order = np.argsort(leaf, kind="stable")
    row, leaf, searches, own = row[order], leaf[order], searches[order], own[order]
    edges = np.r_[np.nonzero(np.r_[True, leaf[1:] != leaf[:-1]])[0], len(leaf)]
    for a, b in zip(edges[:-1], edges[1:]):
        queries, members = row[a:b][searches[a:b]], row[a:b][own[a:b]]
        if not len(members) or not len(queries):
            continue
        xm = x[members].T
        step = max(1, 4_000_000 // len(members))
        for lo in range(0, len(queries), step):
            qs = queries[lo : lo + step]
            yield qs, members, x[qs] @ xm


# --- most similar --------------------------------------------------------------------------


def most_similar(v: Vectors, k: int = 5, min_cosine: float = -1.0, trees: int = TREES, visits: int = VISITS, leaf: int = LEAF, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """``(a, b, cosine)``: up to k most similar other vectors b of each vector a, of cosine above
    ``min_cosine``, as row ids of ``v.base``.

    Equal cosines are ordered by row id, copies of one vector by their id. Copies are each other's
    neighbours with cosine 1. A lone vector has no neighbour; an empty collection gives no row.
    """
    forest = _fit(v, sample, trees, leaf, visits, seed)
    dim = v.dim

    def rerank(pdf: pd.DataFrame) -> pd.DataFrame:
        rid = pdf["rid"].to_numpy()
        qa, qb, qs = [], [], []
        for queries, members, cos in _leaf_blocks(pdf, dim):
            cos[queries[:, None] == members[None, :]] = -2.0
            hit = np.nonzero((cos > min_cosine).any(axis=1))[0]
            if not len(hit):
                continue
            c = cos[hit] if len(hit) < len(queries) else cos
            if c.shape[1] > k:
                top = np.argpartition(-c, k - 1, axis=1)[:, :k]
                val = np.take_along_axis(c, top, 1)
            else:
                top, val = np.broadcast_to(np.arange(c.shape[1]), c.shape), c
            good = val > min_cosine
            qa.append(np.repeat(queries[hit], good.sum(axis=1)))
            qb.append(members[top[good]])
            qs.append(val[good])
        if not qa:
            return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64"), "cosine": pd.Series(dtype="float32")})
        a, b, s = np.concatenate(qa), np.concatenate(qb), np.concatenate(qs)
        order = np.lexsort((b, -s, a))
        a, b, s = a[order], b[order], s[order]
        fresh = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]  # a pair met in two leaves of a bucket
        a, b, s = a[fresh], b[fresh], s[fresh]
        start = np.nonzero(np.r_[True, a[1:] != a[:-1]])[0]
        rank = np.arange(len(a)) - np.repeat(start, np.diff(np.r_[start, len(a)]))
        top = rank < k + 1
        return pd.DataFrame({"a": rid[a[top]], "b": rid[b[top]], "cosine": s[top]})

    found = _visits(v, forest, visits).groupBy("bucket").applyInPandas(rerank, "a bigint, b bigint, cosine float")
    # A vector's candidates of all its buckets meet once: at most visits * (k + 1) rows each.
    merged = found.repartition("a").groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
    best = Window.partitionBy("a").orderBy(F.desc("cosine"), "b")
    lists = merged.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).drop("n")
    # Copies come back: in a list a vector stands for its first copies, and each copy has the list.
    few = v.first_copies(k + 1).withColumnsRenamed({"rep": "b", "member": "to"})
    own = v.copies.select(F.col("rep").alias("a")).distinct().select("a", F.col("a").alias("b"), F.lit(2.0).cast("float").alias("cosine"))
    wide = lists.unionByName(own).join(few, "b", "left").select("a", "b", F.coalesce("to", "b").alias("to"), F.coalesce("ord", F.lit(1)).alias("ord"), "cosine")
    each = v.copies.select(F.col("rep").alias("a"), F.col("member").alias("from"))
    wide = wide.join(each, "a", "left").withColumn("from", F.coalesce("from", "a")).where(F.col("from") != F.col("to"))
    last = Window.partitionBy("from").orderBy(F.desc("cosine"), "b", "ord")
    wide = wide.withColumn("n", F.row_number().over(last)).where(F.col("n") <= k)
    return wide.select(F.col("from").alias("a"), F.col("to").alias("b"), F.least("cosine", F.lit(1.0).cast("float")).alias("cosine"))


def pairs_by_id(v: Vectors, lists: DataFrame) -> DataFrame:
    """Neighbour lists as unordered pairs ``(a, b)`` of ids, each once, the smaller id first."""
    pairs = lists.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    ids = v.base.select("rid", "id")
    x = pairs.join(ids.withColumnsRenamed({"rid": "a", "id": "ia"}), "a").join(ids.withColumnsRenamed({"rid": "b", "id": "ib"}), "b")
    return x.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"))


# --- clusters ------------------------------------------------------------------------------


def _cells(v: Vectors, forest: Forest, visits: int, min_cosine: float) -> DataFrame:
    """``(rid, cell, density)``: the cells each vector lies in. A cell is the vectors of a bucket's
    leaves that alike pairs join, named by its smallest row id. ``density``: the most rows alike to
    this one seen in one leaf, copies of it and of the others counted. Vectors without an alike one
    have no row."""
    dim = v.dim

    def join_up(pdf: pd.DataFrame) -> pd.DataFrame:
        rid = pdf["rid"].to_numpy()
        n = len(rid)
        up = np.arange(n)
        weight = pdf["w"].to_numpy().astype(np.float64)
        density = np.zeros(n, np.int64)

        def root(i: int) -> int:
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        for queries, members, cos in _leaf_blocks(pdf, dim):
            near = cos > min_cosine
            near &= queries[:, None] != members[None, :]
            links = near.sum(axis=1, dtype=np.int32)
            rows = (near @ weight[members] + weight[queries] - 1).astype(np.int64)
            density[queries] = np.maximum(density[queries], np.where(links > 0, rows, 0))
            # Each vector's first alike member, then the rest by rows: as many unions as rows and runs, not as pairs.
            todo = np.nonzero(links)[0]
            seen = np.zeros(len(members), bool)
            for i in todo:
                js = np.nonzero(near[i])[0]
                r = root(queries[i])
                new = js[~seen[js]]
                seen[new] = True
                for j in members[new]:
                    s = root(j)
                    if s != r:
                        if rid[s] < rid[r]:
                            r, s = s, r
                        up[s] = r
                rest = js[seen[js]]
                if len(rest):
                    for s in {root(j) for j in np.unique(_jump(up, members[rest]))}:
                        if s != r:
                            if rid[s] < rid[r]:
                                r, s = s, r
                            up[s] = r
        all_roots = _jump(up, np.arange(n))
        keep = np.nonzero(density)[0]
        both = np.union1d(keep, np.nonzero(np.bincount(all_roots, minlength=n)[all_roots] > 1)[0])
        return pd.DataFrame({"rid": rid[both], "cell": rid[all_roots[both]], "density": density[both]})

    return _visits(v, forest, visits, weighted=True).groupBy("bucket").applyInPandas(join_up, "rid bigint, cell bigint, density bigint")


def _jump(up: np.ndarray, at: np.ndarray) -> np.ndarray:
    r = up[at]
    while True:
        s = up[r]
        if (s == r).all():
            return r
        r = s


def smallest_labels(edges: DataFrame) -> DataFrame:
    """``(node, label)`` of every node of ``edges (u, v)`` but the smallest of each group: that smallest one.

    Minimum labels are propagated to convergence (see ``components``).
    """
    return components(edges.where("u != v"), "u", "v").where("node != root").withColumnRenamed("root", "label")


def clusters(v: Vectors, min_cosine: float, trees: int = TREES, visits: int = VISITS, leaf: int = LEAF, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """``(rid, label, density)`` of every vector that has an alike one (cosine above ``min_cosine``):
    vectors joined by alike pairs, directly or through others, have the same label.

    Cells that share a vector are adjacent; a vector of several cells ties them to the smallest of
    them, and minimum labels run over these ties only. Exact copies are alike and have one density. An
    empty collection gives no row.
    """
    forest = _fit(v, sample, trees, leaf, visits, seed)
    cells = _cells(v, forest, visits, min_cosine)
    copies = v.copies.select(F.col("member").alias("rid"), F.col("rep").alias("cell"), F.lit(0).cast("bigint").alias("density"))
    own = v.copy_counts().select(F.col("rep").alias("rid"), F.col("rep").alias("cell"), (F.col("n") - 1).alias("density"))
    cells = cut(cells.unionByName(copies).unionByName(own), "cells").df
    of = cells.groupBy("rid").agg(F.min("cell").alias("low"), F.max("cell").alias("high"), F.max("density").alias("density"))
    of = cut(of, "cell_of").df
    ties = cells.join(of.where("low != high").select("rid", "low"), "rid").where("cell != low").select(F.col("cell").alias("u"), F.col("low").alias("v")).distinct()
    labels = smallest_labels(ties)
    # Each copy has the density of the vector it is a copy of.
    of_rep = of.join(v.copy_counts().select(F.col("rep").alias("rid")), "rid").select(F.col("rid").alias("rep"), F.col("density").alias("d"))
    dense = v.copies.join(of_rep, "rep").select(F.col("member").alias("rid"), "d")
    of = of.join(dense, "rid", "left").withColumn("density", F.coalesce("d", "density")).drop("d")
    return of.join(labels, F.col("low") == F.col("node"), "left").select("rid", F.coalesce("label", "low").alias("label"), "density")


def groups_by_id(v: Vectors, labelled: DataFrame, least: int = 3) -> DataFrame:
    """``(first_id, id, n, density)`` of the members of every group of ``least`` or more."""
    named = cut(labelled.join(v.base.select("rid", "id"), "rid").select("label", "id", "density"), "groups").df
    sizes = named.groupBy("label").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return named.join(sizes, "label").select("first_id", "id", "n", "density")
