"""The registered queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstone.llm import bpe, conversations, lookalikes, mail, mixing, privacy, splitting, vectors
from loomstone.llm.common import kind_key, one_text_per_id, table


ALIKE = 0.72
"""Two signals are alike above this cosine."""
SECRET = b"loomstone"
"""The key of surrogates in ``p5_found`` and ``p5_surrogates``; a deployment sets its own."""


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Alike pairs of which one is among the five most similar of the other."""
    v = vectors.Vectors(table(spark, d, "capture_signals"))
    found = vectors.pairs_by_id(v, vectors.most_similar(v, 5, ALIKE))
    return found.select(F.col("a").alias("signal_a"), F.col("b").alias("signal_b"))


def p1_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar other signals of every signal, alike or not."""
    v = vectors.Vectors(table(spark, d, "capture_signals"))
    lists = vectors.most_similar(v, 5, visits=vectors.FAR_VISITS)
    ids = v.base.select("rid", "id")
    x = lists.join(ids.withColumnsRenamed({"rid": "a", "id": "signal_id"}), "a").join(ids.withColumnsRenamed({"rid": "b", "id": "neighbour_id"}), "b")
    return x.select("signal_id", "neighbour_id", "cosine")


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of every signal whose text is too large."""
    signals = table(spark, d, "capture_signals").where(splitting.is_oversized(F.col("redacted_text")))
    return splitting.split(one_text_per_id(signals), "id", "redacted_text").withColumnRenamed("id", "signal_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Signals that the splitter has split."""
    return p2_pieces(spark, d).where((F.col("piece_no") == 0) & (F.col("n_pieces") > 1)).select("signal_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Every message of every kept conversation."""
    return conversations.rebuild(table(spark, d, "session_events")).select("session_id", "turn_no", "uuid")


def p3_turns(spark: SparkSession, d: str) -> DataFrame:
    """The turns with their role and text."""
    turns = conversations.rebuild(table(spark, d, "session_events"))
    e = table(spark, d, "session_events")
    kind = kind_key(F.col("kind"))
    own = e.where((F.col("depth") == 0) & kind.isin("user_text", "assistant_text") & F.col("text").rlike(r"[^ \t\r\n]"))
    texts = own.groupBy("session_id", "uuid").agg(F.min_by("text", F.struct("ts", "path", "text")).alias("text"))
    return turns.join(texts, ["session_id", "uuid"]).select("session_id", "turn_no", "uuid", "role", "text")


def _mails(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "capture_signals").where(F.col("id").isNotNull() & mail.is_mail(F.col("source")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The kinds of foreign parts in each mail. All rows of a signal hold one text: rows are reduced
    where they lie and only what was found moves."""
    m = _mails(spark, d)
    found = mail.parts(m, "id", "redacted_text", mail.fit_mails(m, "redacted_text"))
    return found.select(F.col("id").alias("signal_id"), "foreign_part").distinct()


def p4_new_text(spark: SparkSession, d: str) -> DataFrame:
    """What the sender of each mail newly wrote."""
    m = _mails(spark, d)
    one = one_text_per_id(m)
    return mail.reduce(one, "id", "redacted_text", mail.fit_mails(m, "redacted_text")).withColumnRenamed("id", "signal_id")


def _places(spark: SparkSession, d: str) -> DataFrame:
    """``(k, text)`` of all texts that may hold personal data; ``k`` names the place."""
    signals = table(spark, d, "capture_signals").where(F.col("id").isNotNull())
    a = signals.select(F.struct(F.lit("signal").alias("place"), F.col("id").alias("record_id"), F.lit(0).alias("item_no")).alias("k"), F.col("redacted_text").alias("text"))
    sessions = table(spark, d, "interview_sessions").where(F.col("id").isNotNull())
    x = sessions.select("id", F.explode("answers").alias("a")).where(F.col("a.question_index").isNotNull())
    b = x.select(F.struct(F.lit("answer").alias("place"), F.col("id").alias("record_id"), F.col("a.question_index").alias("item_no")).alias("k"), F.col("a.transcript").alias("text"))
    return a.unionByName(b)


def _names(spark: SparkSession, d: str) -> privacy.NameModel:
    return privacy.fit_names(_places(spark, d), "text", table(spark, d, "known_people"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The kinds of personal data in each record: of what surrogates were put in place of."""
    found = privacy.kinds(_places(spark, d), "k", "text", _names(spark, d), SECRET)
    return found.select("k.place", "k.record_id", "k.item_no", F.col("kind").alias("pii_kind"))


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every text with placeholders for what it held, and the log of them."""
    one = _places(spark, d).groupBy("k").agg(F.max("text").alias("text"))
    r = privacy.redacted(one, "k", "text", _names(spark, d))
    return r.select("k.place", "k.record_id", "k.item_no", "text", "log")


def p5_surrogates(spark: SparkSession, d: str) -> DataFrame:
    """Every text with surrogates, the same for the same entity throughout."""
    r = privacy.with_surrogates(_places(spark, d), "k", "text", _names(spark, d), SECRET)
    return r.select("k.place", "k.record_id", "k.item_no", "text")


def _grouped(spark: SparkSession, d: str) -> DataFrame:
    v = vectors.Vectors(table(spark, d, "capture_signals"))
    return vectors.groups_by_id(v, vectors.clusters(v, ALIKE))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Every member of every group of three or more signals."""
    return _grouped(spark, d).select(F.col("first_id").alias("first_signal_id"), F.col("id").alias("signal_id"))


def p6_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Each group with its size and its three most typical members, those with the most alike rows in one leaf."""
    g = _grouped(spark, d)
    w = Window.partitionBy("first_id").orderBy(F.desc("density"), "id")
    top = g.withColumn("r", F.row_number().over(w)).where(F.col("r") <= 3)
    return top.groupBy(F.col("first_id").alias("first_signal_id"), F.col("n").alias("n_signals")).agg(F.sort_array(F.collect_list(F.struct("r", "id"))).getField("id").alias("typical_ids"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return bpe.encode(table(spark, d, "documents"), "text", "doc_id")


def _doc_tokens(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    n = bpe.encode(docs.select(F.struct("doc_id", "source").alias("k"), "text"), "text", "k", counts_only=True)
    return n.select("k.doc_id", "k.source", "n_tokens")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents of each mix with the number of their uses."""
    return mixing.mix(_doc_tokens(spark, d), table(spark, d, "mix_targets"))[0].select("mix_id", "source", "doc_id", "n_tokens", "uses")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual shares of each source of each mix."""
    return mixing.mix(_doc_tokens(spark, d), table(spark, d, "mix_targets"))[1]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that look the same and are written differently."""
    return lookalikes.lookalike_pairs(table(spark, d, "documents"), "doc_id", "text").select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"))


def p9_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every document's text in its one form."""
    return lookalikes.canonical(table(spark, d, "documents"), "doc_id", "text")


def p9_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every document whose form is written in several ways, with the first document of its form and of its writing."""
    g = lookalikes.lookalike_groups(table(spark, d, "documents"), "doc_id", "text")
    return g.select("doc_id", "first_of_form", "first_of_writing", F.col("n").alias("n_documents"))


def p6_past(spark: SparkSession, d: str) -> DataFrame:
    """Each cluster of past weeks with the group that now holds most of its members, and how many."""
    past = table(spark, d, "synthesis_clusters").where(F.col("id").isNotNull())
    one = past.groupBy("id").agg(F.max("cluster_label").alias("cluster_label"), F.max("signal_ids").alias("s"))
    members = one.select(F.col("id").alias("cluster_id"), "cluster_label", F.size("s").alias("n_past"), F.explode(F.array_distinct("s")).alias("id"))
    now = _grouped(spark, d).select("first_id", "id", F.col("n").alias("n_now"))
    met = members.join(now, "id").groupBy("cluster_id", "cluster_label", "n_past", "first_id", "n_now").agg(F.count(F.lit(1)).alias("n_shared"))
    best = met.groupBy("cluster_id", "cluster_label", "n_past").agg(F.max(F.struct("n_shared", F.col("first_id"), "n_now")).alias("b"))
    return best.select("cluster_id", "cluster_label", "n_past", F.col("b.first_id").alias("first_signal_id"), "b.n_now", "b.n_shared")


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_neighbours, p2_found, p2_pieces, p3_found, p3_turns, p4_found, p4_new_text, p5_found, p5_redacted, p5_surrogates, p6_found, p6_clusters, p6_past, p7_ids, p8_mix, p8_shares, p9_found, p9_forms, p9_groups)}


_USABLE = """
        WITH RECURSIVE latest AS (
          SELECT id, is_deleted, embedding, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST, is_deleted DESC NULLS LAST) AS rn FROM capture_signals WHERE id IS NOT NULL),
        v AS (SELECT id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM latest
              WHERE rn = 1 AND NOT coalesce(is_deleted, false) AND len(embedding) = 128 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 128
                AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        alike AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.id <> b.id WHERE list_cosine_similarity(a.e, b.e) > 0.72)"""

_TURNS = r"""
        WITH m AS (
          SELECT session_id, ts, path, uuid, text, replace(replace(lower(trim(kind)), '-', '_'), ' ', '_') AS k
          FROM session_events
          WHERE depth = 0 AND regexp_matches(text, '[^ \t\r\n]')
            AND replace(replace(lower(trim(kind)), '-', '_'), ' ', '_') IN ('user_text', 'assistant_text')),
        ok AS (SELECT session_id FROM m GROUP BY 1 HAVING count(*) FILTER (ts IS NULL OR uuid IS NULL OR uuid = '') = 0),
        one AS (SELECT *, row_number() OVER (PARTITION BY session_id, uuid ORDER BY ts, path) AS rn FROM m SEMI JOIN ok USING (session_id)),
        t AS (SELECT *, row_number() OVER w AS turn_no, lead(k) OVER w AS nxt FROM one WHERE rn = 1
              WINDOW w AS (PARTITION BY session_id ORDER BY ts, path, uuid)),
        good AS (SELECT session_id FROM t GROUP BY 1
                 HAVING count(*) FILTER (k = 'user_text' AND coalesce(nxt, '') <> 'assistant_text') = 0
                    AND count(*) FILTER (turn_no = 1 AND k = 'user_text') = 1)"""

ORACLE = {
    "p1_found": _USABLE + """
        SELECT DISTINCT least(a, b) AS signal_a, greatest(a, b) AS signal_b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS r FROM alike) WHERE r <= 5""",
    "p6_found": _USABLE + """,
        reach AS (SELECT a AS node, a AS other FROM alike UNION SELECT r.node, x.b FROM reach r JOIN alike x ON x.a = r.other),
        g AS (SELECT node, min(other) AS first_signal_id, count(*) AS n FROM reach GROUP BY 1)
        SELECT first_signal_id, node AS signal_id FROM g WHERE n >= 3""",
    "p2_found": r"""
        SELECT id AS signal_id FROM (SELECT id, any_value(redacted_text) AS t FROM capture_signals WHERE id IS NOT NULL GROUP BY id)
        WHERE length(t) > 6000 OR len(regexp_extract_all(t, '[^ \t\r\n]+')) > 800""",
    "p3_found": _TURNS + """
        SELECT session_id, CAST(turn_no AS INTEGER) AS turn_no, uuid FROM t SEMI JOIN good USING (session_id)""",
    "p3_turns": _TURNS + """
        SELECT session_id, CAST(turn_no AS INTEGER) AS turn_no, uuid, CASE k WHEN 'user_text' THEN 'user' ELSE 'assistant' END AS role, x.text FROM t SEMI JOIN good USING (session_id)
        JOIN (SELECT session_id, uuid, arg_min(text, (ts, path, text)) AS text FROM m WHERE ts IS NOT NULL AND path IS NOT NULL AND uuid IS NOT NULL GROUP BY ALL) x USING (session_id, uuid)""",
    "p6_past": _USABLE + """,
        reach AS (SELECT a AS node, a AS other FROM alike UNION SELECT r.node, x.b FROM reach r JOIN alike x ON x.a = r.other),
        g AS (SELECT node, min(other) AS first_id, count(*) AS n_now FROM reach GROUP BY 1 HAVING count(*) >= 3),
        one AS (SELECT id AS cluster_id, max(cluster_label) AS cluster_label, max(signal_ids) AS s FROM synthesis_clusters WHERE id IS NOT NULL GROUP BY 1),
        met AS (SELECT cluster_id, cluster_label, len(s) AS n_past, first_id, n_now, count(*) AS n_shared FROM (SELECT *, unnest(list_distinct(s)) AS id FROM one) JOIN g ON g.node = id GROUP BY ALL)
        SELECT cluster_id, cluster_label, CAST(n_past AS INTEGER) AS n_past, first_id AS first_signal_id, n_now, n_shared FROM met QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY n_shared DESC, first_id DESC) = 1""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
