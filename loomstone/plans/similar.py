"""Clusters of vectors and their ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.functions.arrays import cosine
from loomstone.operators import chunking
from loomstone.operators import similarity as S
from loomstone.plans.common import Catalog, Tables, now_of
from loomstone.plans.texts import ws

catalog = Catalog()
query = catalog.query

THRESHOLD = 0.4

# The rows of the small table with norms; sums in double as in the engine.
_V = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)"
_EDGES = f"{_V}, edges AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id < y.vec_id WHERE list_cosine_similarity(x.e, y.e) > {THRESHOLD})"
_REACH = f"{_EDGES}, both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges), reach AS (SELECT a AS node, a AS other FROM both_ways UNION SELECT r.node, w.b FROM reach r JOIN both_ways w ON w.a = r.other)"
_MEMBERS = f"{_REACH}, roots AS (SELECT node, min(other) AS root FROM reach GROUP BY 1), members AS (SELECT root AS cluster_id, node AS vec_id, count(*) OVER (PARTITION BY root) AS n FROM roots)"


@query(f"WITH {_EDGES} SELECT vec_id, count(*) AS n_links FROM (SELECT a AS vec_id FROM edges UNION ALL SELECT b FROM edges) GROUP BY 1")
def similarity_links(t: Tables) -> DataFrame:
    """How many vectors each vector is joined to."""
    return S.link_counts(t.embeddings, "vec_id", "embedding", THRESHOLD)


@query(f"WITH RECURSIVE {_MEMBERS} SELECT cluster_id, vec_id, n FROM members WHERE n >= 3")
def similarity_clusters(t: Tables) -> DataFrame:
    return S.clusters(t.embeddings, "vec_id", "embedding", THRESHOLD)


@query(f"""WITH RECURSIVE {_MEMBERS}, s AS (
             SELECT cluster_id, count(*) AS n_signals, avg((epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts)) / 86400000000.0) AS avg_age_days
             FROM members JOIN events ON event_id = vec_id WHERE n >= 3 GROUP BY 1),
           r AS (SELECT *, n_signals + greatest(0.0, 30.0 - avg_age_days) / 30 AS score FROM s)
           SELECT CAST(row_number() OVER (ORDER BY score DESC, cluster_id) AS INTEGER) AS rank, cluster_id, n_signals, round(avg_age_days, 6) AS avg_age_days, round(score, 6) AS score FROM r""")
def cluster_scores_topk(t: Tables) -> DataFrame:
    """The flagship: which clusters there are in the corpus, and how they rank by size and age."""
    m = S.clusters(t.embeddings, "vec_id", "embedding", THRESHOLD)
    e = t.events
    x = m.join(e.select(F.col("event_id").alias("vec_id"), "ts"), "vec_id")
    s = S.scored(x, "ts", now_of(e, "ts"))
    return s.select("rank", "cluster_id", "n_signals", F.round("avg_age_days", 6).alias("avg_age_days"), F.round("score", 6).alias("score"))


@query(f"""WITH {_V} SELECT x.vec_id AS query_id, y.vec_id, round(list_cosine_similarity(x.e, y.e), 6) AS cosine
           FROM v x JOIN v y ON x.vec_id <> y.vec_id WHERE x.vec_id % 100 = 0
           QUALIFY row_number() OVER (PARTITION BY x.vec_id ORDER BY list_cosine_similarity(x.e, y.e) DESC, y.vec_id) <= 5""")
def vector_topk(t: Tables) -> DataFrame:
    """Exact top five for the stated query set, the vectors whose id is divisible by 100, against all rows:
    each task holds a block of queries against its rows and keeps five per query, which meet once."""
    import numpy as np
    import pandas as pd

    from pyspark.sql import Window

    v = t.embeddings.where("vec_id is not null and size(embedding) > 0").select("vec_id", "embedding")
    n = v.count()
    slots, parts = max(1, n // 500_000), max(1, n // 20_000)  # blocks of some thousand queries and some ten thousand rows
    queries = v.where("vec_id % 100 = 0").withColumn("slot", F.pmod(F.xxhash64("vec_id"), F.lit(slots)).cast("int"))
    rows = v.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int"))
    routed = queries.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("q", F.lit(True)).unionByName(rows.withColumn("q", F.lit(False)))

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf.q], pdf[~pdf.q]
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "vec_id": [], "cosine": []})
        c = S._unit(a.embedding) @ S._unit(b.embedding).T
        qa, ib = a.vec_id.to_numpy(), b.vec_id.to_numpy()
        c[qa[:, None] == ib[None, :]] = -2
        k = min(5, c.shape[1])
        kth = -np.partition(-c, k - 1, axis=1)[:, k - 1]
        i, j = np.nonzero((c >= kth[:, None]) & (c > -2))
        return pd.DataFrame({"query_id": qa[i], "vec_id": ib[j], "cosine": c[i, j]})

    near = routed.groupBy("slot", "part").applyInPandas(best, "query_id bigint, vec_id bigint, cosine double")
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")
    return near.withColumn("r", F.row_number().over(w)).where("r <= 5").select("query_id", "vec_id", F.round("cosine", 6).alias("cosine"))


@query(f"""WITH {_V}, p AS (SELECT *, lead(e) OVER (ORDER BY vec_id) AS nxt FROM v) SELECT vec_id, round(list_cosine_similarity(e, nxt), 6) AS cosine FROM p WHERE nxt IS NOT NULL""")
def neighbour_cosine(t: Tables) -> DataFrame:
    """The cosine function on vectors of consecutive ids."""
    v = t.embeddings.select("vec_id", "embedding")
    n = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("nxt"))
    return v.join(n, "vec_id").select("vec_id", F.round(cosine(F.col("embedding"), F.col("nxt")), 6).alias("cosine"))


@query(f"""WITH w AS (SELECT doc_id, md5(unnest({ws('lower(text)')})) AS m FROM documents WHERE text <> ''),
           p AS (SELECT doc_id, CAST('0x' || substr(m, 1, 8) AS BIGINT) % 64 AS k, sum(CASE WHEN contains('02468ace', substr(m, 9, 1)) THEN 1 ELSE -1 END) AS x FROM w GROUP BY ALL),
           n AS (SELECT doc_id, sqrt(sum(x * x)) AS norm FROM p GROUP BY 1),
           g AS (SELECT doc_id, k FROM (SELECT doc_id FROM documents WHERE text <> ''), (SELECT unnest(range(64)) AS k)),
           v AS (SELECT doc_id, k, CASE WHEN norm > 0 THEN coalesce(x, 0) / norm ELSE 0 END AS x FROM g LEFT JOIN p USING (doc_id, k) LEFT JOIN n USING (doc_id))
           SELECT doc_id, max(round(x, 4)) AS x_max, min(round(x, 4)) AS x_min, round(sum(x * (k + 1)), 1) AS weighted FROM v GROUP BY 1""")
def embedded_documents(t: Tables) -> DataFrame:
    """Documents with vectors of the local embedding provider, told by three figures of each."""
    d = t.documents.where("text <> ''").select("doc_id", chunking.embed(F.col("text")).alias("e"))
    x = F.transform("e", lambda v: v.cast("double"))
    weighted = F.aggregate(F.transform(x, lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v)
    near = lambda c: F.round(c, 4)
    return d.select("doc_id", near(F.array_max(x)).alias("x_max"), near(F.array_min(x)).alias("x_min"), F.round(weighted, 1).alias("weighted"))
