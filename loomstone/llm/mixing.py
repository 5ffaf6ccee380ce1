"""Mixing sources to target weights by capped water-filling.

A mix names the weight of each source, how often a document may be used in all, and the size of
the mix over the size of the corpus, in tokens. Sources whose weight asks for more than their
documents may give are clamped there and the rest of the mix is shared among the others by their
weights, until nothing more is clamped. A source's epochs then are a whole number of uses of
each of its documents and a seeded sample of them used once more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.llm.common import cut

BUCKETS = 1 << 12


def water_fill(weights: dict[str, float], sizes: dict[str, int], caps: dict[str, int | None], total: float) -> dict[str, float]:
    """Tokens to take of each source.

    Sources without weight or tokens get nothing; where all sources are clamped the mix is smaller
    than asked.
    """
    open_ = {s for s, w in weights.items() if w and w > 0 and sizes.get(s, 0) > 0 and (caps.get(s) is None or caps[s] > 0)}
    take = dict.fromkeys(weights, 0.0)
    left = float(total)
    while open_ and left > 0:
        level = sum(weights[s] for s in open_)
        full = {s: float(caps[s]) * sizes[s] for s in open_ if caps.get(s) is not None and left * weights[s] / level >= caps[s] * sizes[s]}
        if not full:
            for s in open_:
                take[s] = left * weights[s] / level
            break
        take.update(full)
        left -= sum(full.values())
        open_ -= full.keys()
    return take


def mix(docs: DataFrame, targets: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Uses and shares.

    ``docs``: ``(doc_id, source, n_tokens)``, ``targets``: the columns of ``mix_targets`` (a small
    fixed table; its rows and one size per named source are what the driver sees).

    Uses: ``(mix_id, source, doc_id, n_tokens, uses)`` of every document used at least once. Shares:
    one row for each row of ``targets``, with ``available_tokens``, ``wanted_tokens``,
    ``actual_tokens``, ``target_share`` (relative to the mix's sum) and ``actual_share`` (null where
    the mix is empty). Documents without source, of a source no mix names, or without tokens are
    not used; the size of a mix is relative to all documents' tokens. A target row without mix or
    source counts for nothing; a repeated one adds its weight and the smallest cap holds. Weight null
    is 0; a ratio or cap below 0 is 0.

    Sampling: documents lie on a seeded hash line; a source's part use takes them in that order until
    its tokens are reached, the last one where that comes nearer. The line is cut into buckets whose
    sums find the bucket in which a source ends; only that bucket's rows are ordered.
    """
    spark = docs.sparkSession
    rows = [r for r in targets.select("mix_id", "source", "target_share", "max_repeats", "size_ratio").collect() if r.mix_id is not None and r.source is not None]
    sized = cut(
        docs.where(F.col("doc_id").isNotNull()).select(
            "doc_id", "source", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.xxhash64(F.lit(seed), F.col("doc_id").cast("string")).alias("h")
        ),
        "sized",
    ).df
    total = sized.agg(F.sum("n_tokens")).first()[0] or 0
    named = sorted({r.source for r in rows})
    per_source = {r.source: r.n for r in sized.where(F.col("source").isin(named)).groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()} if named else {}
    plan = []
    for mix_id in sorted({r.mix_id for r in rows}):
        own = [r for r in rows if r.mix_id == mix_id]
        weights: dict[str, float] = {}
        caps: dict[str, int | None] = {}
        for r in own:
            weights[r.source] = weights.get(r.source, 0.0) + max(r.target_share or 0.0, 0.0)
            cap = None if r.max_repeats is None else max(int(r.max_repeats), 0)
            known = caps.get(r.source)
            caps[r.source] = cap if known is None else known if cap is None else min(known, cap)
        ratio = max([x.size_ratio for x in own if x.size_ratio is not None], default=1.0)
        take = water_fill(weights, per_source, caps, max(ratio, 0.0) * total)
        whole = sum(weights.values())
        for s in sorted(weights):
            n = per_source.get(s, 0)
            epochs = take[s] / n if n else 0.0
            full = int(epochs + 1e-9)
            plan.append((mix_id, s, weights[s] / whole if whole else 0.0, caps[s], n, take[s], full, max(0.0, take[s] - full * n)))
    schema = "mix_id string, source string, target_share double, max_repeats int, available_tokens long, wanted_tokens double, full int, part double"
    plans = spark.createDataFrame(plan, schema)
    bucket = F.shiftrightunsigned("h", 52).cast("int")
    used = sized.where((F.col("n_tokens") > 0) & F.col("source").isin(named)).withColumn("bucket", bucket)
    sums = used.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("b"))  # at most sources x BUCKETS rows
    upto = F.sum("b").over(Window.partitionBy("source").orderBy("bucket"))
    ends = sums.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("b"))
    # The bucket in which a part use ends: the first whose running sum reaches it.
    edge = (
        plans.where(F.col("part") > 0)
        .join(F.broadcast(ends), "source")
        .where((F.col("before") < F.col("part")) & (F.col("upto") >= F.col("part")))
        .select("mix_id", "source", F.col("bucket").alias("edge"), F.col("before").alias("edge_before"))
    )
    plans2 = plans.join(edge, ["mix_id", "source"], "left")
    j = used.join(F.broadcast(plans2), "source")
    inside = F.coalesce(F.col("bucket") == F.col("edge"), F.lit(False))
    line = Window.partitionBy("mix_id", "source").orderBy("h", "doc_id")
    at_edge = j.where(inside).withColumn("reached", F.col("edge_before") + F.sum("n_tokens").over(line))
    near = F.col("reached") - F.col("n_tokens") / 2 <= F.col("part")  # taken if that comes nearer
    cols = ["mix_id", "source", "doc_id", "n_tokens"]
    uses = at_edge.select(*cols, (F.col("full") + near.cast("int")).alias("uses")).unionByName(
        j.where(~inside).select(*cols, (F.col("full") + F.coalesce(F.col("bucket") < F.col("edge"), F.lit(False)).cast("int")).alias("uses"))
    )
    uses = uses.where(F.col("uses") > 0)
    got = uses.groupBy("mix_id", "source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("actual_tokens"))
    shares = plans.drop("full", "part").join(F.broadcast(got), ["mix_id", "source"], "left").withColumn("actual_tokens", F.coalesce("actual_tokens", F.lit(0)))
    of = F.sum("actual_tokens").over(Window.partitionBy("mix_id"))
    shares = shares.withColumn("actual_share", F.when(of > 0, F.col("actual_tokens") / of))
    return uses, shares
