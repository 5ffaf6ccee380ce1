"""Filters, joins, aggregates, windows, top-k, set operations and table upkeep over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions import arrays as A
from loomstone.functions import text as X
from loomstone.operators import sessions as S
from loomstone.operators import tables as T
from loomstone.plans.common import Catalog, Tables, now_of

catalog = Catalog()
query = catalog.query

KIND = "replace(replace(lower(trim(kind)), '-', '_'), ' ', '_')"
SOURCE = "replace(replace(lower(trim(source)), '-', '_'), ' ', '_')"
LATEST = """latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST, is_deleted DESC NULLS LAST, token_count DESC NULLS LAST) AS rn
                 FROM capture_signals WHERE id IS NOT NULL) WHERE rn = 1)"""


# Written out here once more, so that the SQL does not follow the engine's list.
GAP_WORDS = """['a', 'an', 'and', 'are', 'as', 'at', 'be', 'been', 'being', 'but', 'by', 'for', 'from', 'how', 'in', 'is', 'it', 'of', 'on', 'or', 'that', 'the', 'this', 'to', 'was', 'were', 'when', 'where', 'will', 'with']"""


def label(c):
    return F.regexp_replace(F.lower(F.trim(c)), "[- ]", "_")


def latest_signals(t: Tables, *keep: str) -> DataFrame:
    return T.latest_rows(t.capture_signals, "id", ["ingested_at", "is_deleted", "token_count"], ["ingested_at", "is_deleted", *keep])


# --- scans, projections, filters -----------------------------------------------------------


@query("""SELECT id, source, captured_at FROM capture_signals
          WHERE is_deleted = false AND embedding IS NOT NULL AND len(embedding) > 0
            AND captured_at >= (SELECT max(captured_at) FROM capture_signals) - INTERVAL 30 DAY""")
def recent_signals(t: Tables) -> DataFrame:
    s = t.capture_signals
    since = now_of(s, "captured_at") - F.expr("INTERVAL 30 DAYS")
    return s.where(~F.col("is_deleted") & (F.col("captured_at") >= since) & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).select("id", "source", "captured_at")


@query("""SELECT count(*) AS n_recent, count(DISTINCT source) AS n_sources FROM capture_signals
          WHERE captured_at >= (SELECT max(captured_at) FROM capture_signals) - INTERVAL 7 DAY""")
def recent_signal_count(t: Tables) -> DataFrame:
    s = t.capture_signals
    recent = s.where(F.col("captured_at") >= now_of(s, "captured_at") - F.expr("INTERVAL 7 DAYS"))
    return recent.agg(F.count(F.lit(1)).alias("n_recent"), F.countDistinct("source").alias("n_sources"))


@query("""SELECT session_id, candidate_key, n FROM (
            SELECT id AS session_id, candidate_id AS candidate_key, count(*) AS n FROM interview_sessions
            WHERE id IS NOT NULL AND candidate_id IS NOT NULL AND status NOT IN ('completed', 'skipped', 'timed_out') GROUP BY ALL)""")
def open_sessions_by_key(t: Tables) -> DataFrame:
    s = t.interview_sessions.where(F.col("id").isNotNull() & F.col("candidate_id").isNotNull() & ~F.col("status").isin("completed", "skipped", "timed_out"))
    return s.groupBy(F.col("id").alias("session_id"), F.col("candidate_id").alias("candidate_key")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT column_name, value, n FROM (
             SELECT 'pii_status' AS column_name, pii_status AS value, count(*) AS n FROM capture_signals WHERE pii_status NOT IN ('clean', 'redacted') GROUP BY ALL
             UNION ALL SELECT 'kind', kind, count(*) FROM session_events WHERE kind NOT IN ('user_text', 'assistant_text', 'tool_call', 'subagent') GROUP BY ALL
             UNION ALL SELECT 'source', source, count(*) FROM capture_signals WHERE source <> {SOURCE} GROUP BY ALL)""")
def enum_violations(t: Tables) -> DataFrame:
    """Values outside their allowed sets, with their counts."""

    def out(df: DataFrame, column: str, bad) -> DataFrame:
        return df.where(bad).groupBy(F.lit(column).alias("column_name"), F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))

    a = out(t.capture_signals, "pii_status", ~F.col("pii_status").isin("clean", "redacted"))
    b = out(t.session_events, "kind", ~F.col("kind").isin("user_text", "assistant_text", "tool_call", "subagent"))
    c = out(t.capture_signals, "source", F.col("source") != label(F.col("source")))
    return a.unionByName(b).unionByName(c)


@query("""SELECT session_id, cwd_class, count(*) AS n FROM (
            SELECT session_id, CASE WHEN coalesce(cwd, '') = '' THEN 'none' WHEN starts_with(rtrim(lower(cwd), '/'), '/srv/work/monitor') THEN 'denied'
                   WHEN starts_with(rtrim(lower(cwd), '/'), '/srv/work') THEN 'allowed' ELSE 'other' END AS cwd_class FROM session_events WHERE session_id IS NOT NULL) GROUP BY ALL""")
def cwd_prefixes(t: Tables) -> DataFrame:
    c = F.col("cwd")
    kind = F.when(F.coalesce(c, F.lit("")) == "", "none").when(X.under_any(c, ["/srv/work/monitor"]), "denied").when(X.under_any(c, ["/srv/work"]), "allowed").otherwise("other")
    return t.session_events.where("session_id is not null").groupBy("session_id", kind.alias("cwd_class")).agg(F.count(F.lit(1)).alias("n"))


# --- joins ---------------------------------------------------------------------------------


@query(f"""WITH {LATEST}, e AS (SELECT DISTINCT id AS candidate_id, unnest(evidence_chunk_ids) AS signal_id FROM article_candidates)
           SELECT candidate_id, signal_id, captured_at FROM e JOIN latest ON latest.id = signal_id WHERE is_deleted = false""")
def evidence_semi_join(t: Tables) -> DataFrame:
    e = t.article_candidates.select(F.col("id").alias("candidate_id"), F.explode("evidence_chunk_ids").alias("signal_id")).distinct()
    s = latest_signals(t, "token_count", "captured_at").where(~F.col("is_deleted")).select(F.col("id").alias("signal_id"), "captured_at")
    return e.join(s, "signal_id").select("candidate_id", "signal_id", "captured_at")


@query(f"""WITH {LATEST}, e AS (SELECT DISTINCT id AS candidate_id, unnest(evidence_chunk_ids) AS signal_id FROM article_candidates),
           r AS (SELECT candidate_id, signal_id, row_number() OVER (PARTITION BY candidate_id ORDER BY captured_at DESC NULLS LAST, signal_id) AS rank
                 FROM e JOIN latest ON latest.id = signal_id WHERE is_deleted = false)
           SELECT candidate_id, signal_id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def evidence_top5(t: Tables) -> DataFrame:
    """The five latest signals of each candidate, a top-k per group: tasks keep five each before rows move."""
    w = Window.partitionBy("candidate_id").orderBy(F.col("captured_at").desc_nulls_last(), "signal_id")
    return evidence_semi_join(t).withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("candidate_id", "signal_id", "rank")


@query("""WITH s AS (SELECT candidate_id, id, status, started_at, row_number() OVER (PARTITION BY candidate_id ORDER BY started_at DESC NULLS LAST, id DESC, status DESC) AS rn
                     FROM interview_sessions WHERE candidate_id IS NOT NULL),
          c AS (SELECT id AS candidate_id, min(primary_keyword) AS primary_keyword FROM article_candidates GROUP BY 1)
          SELECT s.candidate_id, s.id AS session_id, s.status, c.primary_keyword FROM s JOIN c USING (candidate_id) WHERE rn = 1""")
def latest_session_of_candidate(t: Tables) -> DataFrame:
    s = T.latest_rows(t.interview_sessions, "candidate_id", ["started_at", "id", "status"], ["id", "status"])
    c = t.article_candidates.groupBy(F.col("id").alias("candidate_id")).agg(F.min("primary_keyword").alias("primary_keyword"))
    return s.join(c, "candidate_id").select("candidate_id", F.col("id").alias("session_id"), "status", "primary_keyword")


@query("""WITH s AS (SELECT telegram_chat_id, id, row_number() OVER (PARTITION BY telegram_chat_id ORDER BY coalesce(started_at, TIMESTAMPTZ '1970-01-01 00:00:00+00') DESC, id DESC) AS rn
                     FROM interview_sessions WHERE telegram_chat_id IS NOT NULL AND status NOT IN ('completed', 'skipped', 'timed_out'))
          SELECT telegram_chat_id, id AS session_id FROM s WHERE rn = 1""")
def latest_per_key(t: Tables) -> DataFrame:
    s = t.interview_sessions.where(~F.col("status").isin("completed", "skipped", "timed_out")).withColumn("at", F.coalesce("started_at", F.timestamp_seconds(F.lit(0))))
    return T.latest_rows(s, "telegram_chat_id", ["at", "id"], ["id"]).select("telegram_chat_id", F.col("id").alias("session_id"))


@query("""WITH e AS (SELECT session_id, count(*) AS n_events FROM session_events WHERE session_id IS NOT NULL GROUP BY 1),
          m AS (SELECT session_id, min(title) AS title, true AS has_meta FROM cowork_sessions WHERE session_id IS NOT NULL GROUP BY 1)
          SELECT e.session_id, n_events, title, coalesce(has_meta, false) AS has_meta FROM e LEFT JOIN m USING (session_id)""")
def session_metadata(t: Tables) -> DataFrame:
    e = t.session_events.where("session_id is not null").groupBy("session_id").agg(F.count(F.lit(1)).alias("n_events"))
    m = t.cowork_sessions.where("session_id is not null").groupBy("session_id").agg(F.min("title").alias("title"), F.lit(True).alias("has_meta"))
    return e.join(m, "session_id", "left").select("session_id", "n_events", "title", F.coalesce("has_meta", F.lit(False)).alias("has_meta"))


@query(f"""WITH p AS (SELECT session_id, path, uuid FROM session_events WHERE {KIND} = 'subagent' AND uuid IS NOT NULL),
           c AS (SELECT session_id, list_slice(path, 1, len(path) - 1) AS pp, uuid FROM session_events WHERE depth > 0 AND uuid IS NOT NULL)
           SELECT DISTINCT c.session_id, c.uuid, p.uuid AS parent_uuid FROM c JOIN p ON c.session_id = p.session_id AND c.pp = p.path""")
def subagent_parents(t: Tables) -> DataFrame:
    return S.parents_of(t.session_events)


@query("""WITH d AS (SELECT DISTINCT id AS candidate_id FROM article_candidates WHERE id IS NOT NULL)
          SELECT candidate_id FROM d ANTI JOIN (SELECT candidate_id FROM interview_sessions WHERE status = 'completed' AND candidate_id IS NOT NULL) s USING (candidate_id)""")
def candidates_without_interview(t: Tables) -> DataFrame:
    d = t.article_candidates.where("id is not null").select(F.col("id").alias("candidate_id")).distinct()
    return d.join(t.interview_sessions.where("status = 'completed'").select("candidate_id"), "candidate_id", "left_anti")


@query(f"""WITH {LATEST.replace('token_count DESC NULLS LAST', 'token_count DESC NULLS LAST, redacted_text DESC NULLS LAST')},
           g AS (SELECT id AS candidate_id, unnest(serp_gaps) AS gap, generate_subscripts(serp_gaps, 1) - 1 AS pos FROM (SELECT id, any_value(serp_gaps) AS serp_gaps FROM article_candidates GROUP BY id)),
           tok AS (SELECT candidate_id, pos, gap, unnest(list_filter(string_split_regex(lower(gap), '\\s+'), lambda w: w <> '' AND NOT list_contains({GAP_WORDS}, w))) AS token FROM g),
           ev AS (SELECT DISTINCT c.candidate_id, lower(latest.redacted_text) AS txt FROM (SELECT DISTINCT id AS candidate_id, unnest(evidence_chunk_ids) AS signal_id FROM article_candidates) c JOIN latest ON latest.id = c.signal_id),
           hit AS (SELECT DISTINCT tok.candidate_id, pos FROM tok JOIN ev ON tok.candidate_id = ev.candidate_id AND contains(ev.txt, token))
           SELECT g.candidate_id, CAST(g.pos AS INTEGER) AS pos, g.gap FROM g ANTI JOIN hit ON g.candidate_id = hit.candidate_id AND g.pos = hit.pos""")
def uncovered_gaps(t: Tables) -> DataFrame:
    """Gaps of which no telling word stands in any evidence text of their candidate. Only texts that are
    evidence move; each is met by its own candidate's words."""
    one = t.article_candidates.groupBy("id").agg(F.max("serp_gaps").alias("gaps"))
    g = one.select(F.col("id").alias("candidate_id"), F.posexplode("gaps").alias("pos", "gap"))
    tokens = g.select("candidate_id", "pos", F.explode(X.gap_tokens(F.col("gap"))).alias("token")).distinct()
    e = t.article_candidates.select(F.col("id").alias("candidate_id"), F.explode("evidence_chunk_ids").alias("id")).distinct()
    texts = T.latest_rows(t.capture_signals.join(e.select("id").distinct(), "id", "left_semi"), "id", ["ingested_at", "is_deleted", "token_count", "redacted_text"], ["redacted_text"])
    words = e.join(texts, "id").select("candidate_id", F.lower("redacted_text").alias("txt"))
    hit = tokens.join(words, "candidate_id").where(F.contains("txt", "token")).select("candidate_id", "pos").distinct()
    return g.join(hit, ["candidate_id", "pos"], "left_anti").select("candidate_id", "pos", "gap")


@query("""WITH v AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view'),
          p AS (SELECT user_id, ts FROM events WHERE event_type = 'purchase')
          SELECT v.event_id, min(p.ts) AS reply_ts FROM v LEFT JOIN p ON p.user_id = v.user_id AND p.ts >= v.ts AND p.ts <= v.ts + INTERVAL 7 DAY GROUP BY v.event_id""")
def reply_within_7d(t: Tables) -> DataFrame:
    """For every view the first purchase of its user within seven days, null on time-out. Not a range join:
    views and purchases are laid on one time line per user and week, so a user of any size is cut by
    time, and the next purchase is a running minimum."""
    e = t.events.where(F.col("event_type").isin("view", "purchase")).select("event_id", "user_id", "ts", "event_type")
    week = F.floor(F.unix_timestamp("ts") / (7 * 86400))
    views = e.where("event_type = 'view'").select("user_id", "ts", "event_id", week.alias("week"))
    buys = e.where("event_type = 'purchase'").select("user_id", "ts", F.lit(None).cast("long").alias("event_id"), F.explode(F.array(week, week - 1)).alias("week"))
    w = Window.partitionBy("user_id", "week").orderBy(F.desc("ts"), F.col("event_id").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    line = views.unionByName(buys).withColumn("next", F.min(F.when(F.col("event_id").isNull(), F.col("ts"))).over(w))
    ok = F.col("next") <= F.col("ts") + F.expr("INTERVAL 7 DAYS")
    return line.where("event_id is not null").select("event_id", F.when(ok, F.col("next")).cast("timestamp_ntz").alias("reply_ts"))


@query("""WITH c AS (SELECT id AS cluster_id, unnest(signal_ids) AS signal_id FROM (SELECT id, any_value(signal_ids) AS signal_ids FROM synthesis_clusters GROUP BY id)),
          known AS (SELECT DISTINCT id FROM capture_signals)
          SELECT cluster_id, count(*) AS n_members, count(DISTINCT signal_id) AS n_distinct, count(known.id) AS n_known FROM c LEFT JOIN known ON known.id = signal_id GROUP BY 1""")
def cluster_membership(t: Tables) -> DataFrame:
    c = t.synthesis_clusters.groupBy(F.col("id").alias("cluster_id")).agg(F.max("signal_ids").alias("s")).select("cluster_id", F.explode("s").alias("signal_id"))
    known = t.capture_signals.select(F.col("id").alias("signal_id"), F.lit(1).alias("k")).distinct()
    return c.join(known, "signal_id", "left").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_members"), F.countDistinct("signal_id").alias("n_distinct"), F.count("k").alias("n_known"))


# --- aggregates ----------------------------------------------------------------------------

ALLOW, DENY = ["/srv/work"], ["/srv/work/monitor"]
_N = "length(coalesce(text, ''))"
POST_CHECK = f"""pc AS (
  SELECT session_id, count(*) AS n_events, sum({_N}) AS chars,
         sum(CASE WHEN starts_with(lower(cwd), '/srv/work') AND NOT starts_with(lower(cwd), '/srv/work/monitor') THEN {_N} ELSE 0 END) AS chars_allowed,
         sum(CASE WHEN coalesce(cwd, '') = '' THEN {_N} ELSE 0 END) AS chars_no_cwd
  FROM session_events WHERE depth = 0 AND session_id IS NOT NULL AND {KIND} IN ('user_text', 'assistant_text') GROUP BY session_id),
v AS (SELECT *, CASE WHEN chars - chars_no_cwd > 0 THEN chars_allowed / (chars - chars_no_cwd) END AS share FROM pc),
verdict AS (SELECT session_id, n_events, CAST(chars AS BIGINT) AS chars, CAST(chars_allowed AS BIGINT) AS chars_allowed, CAST(chars_no_cwd AS BIGINT) AS chars_no_cwd, round(share, 6) AS allowed_share,
                   CASE WHEN n_events < 3 OR chars < 500 THEN 'tiny_session' WHEN share < 0.8 THEN 'cwd_majority_outside_allowlist' END AS drop_reason FROM v)"""


def _text_events(t: Tables) -> DataFrame:
    return t.session_events.where((F.col("depth") == 0) & F.col("session_id").isNotNull() & label(F.col("kind")).isin("user_text", "assistant_text"))


@query(f"WITH {POST_CHECK} SELECT * FROM verdict")
def session_post_check(t: Tables) -> DataFrame:
    return S.post_check(_text_events(t), ALLOW, DENY)


@query(f"""WITH {POST_CHECK}, dim AS (SELECT unnest({['kept', *S.DROP_REASONS]!r}) AS reason),
           got AS (SELECT coalesce(drop_reason, 'kept') AS reason, count(*) AS c FROM verdict GROUP BY 1)
           SELECT reason, coalesce(c, 0) AS n FROM dim LEFT JOIN got USING (reason)""")
def drop_reason_summary(t: Tables) -> DataFrame:
    return S.drop_summary(S.post_check(_text_events(t), ALLOW, DENY))


@query("""SELECT 'workspace' AS dimension, coalesce(workspace_id, '(none)') AS value, count(*) AS n FROM cowork_sessions GROUP BY ALL
          UNION ALL SELECT 'account', coalesce(account, '(none)'), count(*) FROM cowork_sessions GROUP BY ALL""")
def sessions_by_dimension(t: Tables) -> DataFrame:
    def by(name: str, c: str) -> DataFrame:
        return t.cowork_sessions.groupBy(F.lit(name).alias("dimension"), F.coalesce(c, F.lit("(none)")).alias("value")).agg(F.count(F.lit(1)).alias("n"))

    return by("workspace", "workspace_id").unionByName(by("account", "account"))


@query(f"""SELECT session_id, count(*) AS lines_in, count(*) FILTER (depth = 0 AND {KIND} IN ('user_text', 'assistant_text') AND text IS NOT NULL) AS events_out,
                  round(100.0 * count(*) FILTER (depth = 0 AND {KIND} IN ('user_text', 'assistant_text') AND text IS NOT NULL) / count(*), 1) AS pct
           FROM session_events WHERE session_id IS NOT NULL GROUP BY 1""")
def session_compression(t: Tables) -> DataFrame:
    out = (F.col("depth") == 0) & label(F.col("kind")).isin("user_text", "assistant_text") & F.col("text").isNotNull()
    g = t.session_events.where("session_id is not null").groupBy("session_id").agg(F.count(F.lit(1)).alias("lines_in"), F.count_if(out).alias("events_out"))
    return g.withColumn("pct", F.round(F.col("events_out") * 100.0 / F.col("lines_in"), 1))


@query("""SELECT lower(r.type) AS type, count(*) AS n, count(DISTINCT id) AS n_signals FROM (SELECT id, unnest(redaction_log) AS r FROM capture_signals) GROUP BY 1""")
def redaction_summary(t: Tables) -> DataFrame:
    x = t.capture_signals.select("id", F.explode("redaction_log").alias("r"))
    return x.groupBy(F.lower("r.type").alias("type")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("n_signals"))


@query(f"""SELECT {SOURCE} AS source_key, count(*) AS n_rows, count(DISTINCT id) AS n_signals, count(*) FILTER (pii_status = 'redacted') AS redacted,
                  count(*) FILTER (is_deleted) AS deleted, count(*) FILTER (embedding IS NULL) AS without_embedding, max(ingested_at) AS last_ingested_at
           FROM capture_signals GROUP BY 1""")
def run_summary(t: Tables) -> DataFrame:
    return t.capture_signals.groupBy(label(F.col("source")).alias("source_key")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("id").alias("n_signals"),
        F.count_if(F.col("pii_status") == "redacted").alias("redacted"),
        F.count_if("is_deleted").alias("deleted"),
        F.count_if(F.col("embedding").isNull()).alias("without_embedding"),
        F.max("ingested_at").alias("last_ingested_at"),
    )


@query("""SELECT id AS session_id, created_at, len(list_filter(answers, lambda a: a.response = 'yes')) AS yes, len(list_filter(answers, lambda a: a.response = 'anon')) AS anon,
                 len(list_filter(answers, lambda a: a.response = 'skip')) AS skip, len(answers) > 0 AND len(list_filter(answers, lambda a: a.response = 'skip')) = len(answers) AS all_skipped,
                 len(signal_exclusions) > 2 AS quality_alert, len(questions) + 1 AS next_question_index
          FROM interview_sessions WHERE answers IS NOT NULL AND questions IS NOT NULL AND signal_exclusions IS NOT NULL""")
def answer_counts(t: Tables) -> DataFrame:
    def n(r: str):
        return F.size(F.filter("answers", lambda a: a["response"] == r)).cast("long")

    s = t.interview_sessions.where("answers is not null and questions is not null and signal_exclusions is not null")
    return s.select(
        F.col("id").alias("session_id"),
        "created_at",
        n("yes").alias("yes"),
        n("anon").alias("anon"),
        n("skip").alias("skip"),
        ((F.size("answers") > 0) & (n("skip") == F.size("answers"))).alias("all_skipped"),
        (F.size("signal_exclusions") > 2).alias("quality_alert"),
        (F.size("questions") + 1).cast("long").alias("next_question_index"),
    )


@query("""SELECT session_id, coalesce(array_to_string(list_sort(list_distinct(list(cwd) FILTER (cwd <> ''))), '|'), '') AS cwds, coalesce(array_to_string(list_sort(list_distinct(list(git_branch) FILTER (git_branch <> ''))), '|'), '') AS branches
          FROM session_events WHERE session_id IS NOT NULL GROUP BY 1""")
def cwds_and_branches(t: Tables) -> DataFrame:
    """Distinct folders and branches of each session, empty where it names none; distinct first, so a hot session brings few values."""
    e = t.session_events.where("session_id is not null")
    pairs = e.select("session_id", F.explode(F.array(F.struct(F.lit("c").alias("k"), F.col("cwd").alias("v")), F.struct(F.lit("b").alias("k"), F.col("git_branch").alias("v")))).alias("x"))
    d = pairs.select("session_id", F.when(F.col("x.v") != "", F.col("x.k")).alias("k"), F.nullif("x.v", F.lit("")).alias("v")).distinct()
    g = d.groupBy("session_id").agg(F.sort_array(F.collect_list(F.when(F.col("k") == "c", F.col("v")))).alias("c"), F.sort_array(F.collect_list(F.when(F.col("k") == "b", F.col("v")))).alias("b"))
    return g.select("session_id", F.array_join("c", "|").alias("cwds"), F.array_join("b", "|").alias("branches"))


@query(f"""WITH {LATEST}, s AS (SELECT date_trunc('day', captured_at) AS day, {SOURCE} AS source_key, token_count FROM latest WHERE captured_at IS NOT NULL)
           SELECT day, source_key, count(*) AS n, sum(CASE WHEN token_count BETWEEN 1 AND 100000 THEN token_count END) AS tokens FROM s GROUP BY ALL""")
def signals_per_day(t: Tables) -> DataFrame:
    s = latest_signals(t, "token_count", "captured_at", "source").where("captured_at is not null")
    good = F.when(F.col("token_count").between(1, 100000), F.col("token_count"))
    return s.groupBy(F.date_trunc("day", "captured_at").alias("day"), label(F.col("source")).alias("source_key")).agg(F.count(F.lit(1)).alias("n"), F.sum(good).alias("tokens"))


@query("""SELECT 'signals_7d' AS metric, CAST(count(*) AS DOUBLE) AS value FROM capture_signals WHERE captured_at >= (SELECT max(captured_at) FROM capture_signals) - INTERVAL 7 DAY
          UNION ALL SELECT 'sources_7d', CAST(count(DISTINCT source) AS DOUBLE) FROM capture_signals WHERE captured_at >= (SELECT max(captured_at) FROM capture_signals) - INTERVAL 7 DAY
          UNION ALL SELECT 'last_synthesis_epoch', CAST(epoch_us(max(created_at)) // 1000000 AS DOUBLE) FROM synthesis_clusters
          UNION ALL SELECT 'session_completion_rate', round(count(*) FILTER (status = 'completed') / count(*), 6) FROM interview_sessions
          UNION ALL SELECT 'open_sessions', CAST(count(DISTINCT id) FILTER (status NOT IN ('completed', 'skipped', 'timed_out')) AS DOUBLE) FROM interview_sessions
          UNION ALL SELECT 'candidates:' || status, CAST(count(*) AS DOUBLE) FROM article_candidates WHERE status IS NOT NULL GROUP BY status""")
def dashboard_metrics(t: Tables) -> DataFrame:
    def metric(df: DataFrame, name: str, value) -> DataFrame:
        return df.agg(value.cast("double").alias("value")).select(F.lit(name).alias("metric"), "value")

    s = t.capture_signals
    recent = s.where(F.col("captured_at") >= now_of(s, "captured_at") - F.expr("INTERVAL 7 DAYS"))
    i = t.interview_sessions
    rows = [
        metric(recent, "signals_7d", F.count(F.lit(1))),
        metric(recent, "sources_7d", F.countDistinct("source")),
        metric(t.synthesis_clusters, "last_synthesis_epoch", F.max(F.unix_timestamp("created_at"))),
        metric(i, "session_completion_rate", F.round(F.try_divide(F.count_if(F.col("status") == "completed"), F.count(F.lit(1))), 6)),
        metric(i, "open_sessions", F.countDistinct(F.when(~F.col("status").isin("completed", "skipped", "timed_out"), F.col("id")))),
        t.article_candidates.where("status is not null").groupBy(F.concat(F.lit("candidates:"), "status").alias("metric")).agg(F.count(F.lit(1)).cast("double").alias("value")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query(f"WITH {POST_CHECK} SELECT session_id, drop_reason IS NULL AS kept, coalesce(drop_reason, '') AS reason FROM verdict")
def audit_rows(t: Tables) -> DataFrame:
    """Kept sessions by id, then dropped ones by reason and id."""
    v = S.post_check(_text_events(t), ALLOW, DENY)
    return v.select("session_id", F.col("drop_reason").isNull().alias("kept"), F.coalesce("drop_reason", F.lit("")).alias("reason")).orderBy(F.desc("kept"), "reason", "session_id")


@query(f"""WITH {LATEST}, e AS (SELECT DISTINCT id AS candidate_id, unnest(evidence_chunk_ids) AS signal_id FROM article_candidates)
           SELECT candidate_id, string_agg(signal_id, '|' ORDER BY captured_at DESC NULLS LAST, signal_id) AS evidence FROM e JOIN latest ON latest.id = signal_id WHERE is_deleted = false GROUP BY 1""")
def ordered_evidence(t: Tables) -> DataFrame:
    """The evidence of each candidate, the latest first; one candidate's list is as long as its own array."""
    x = evidence_semi_join(t)
    key = F.struct((-F.coalesce(F.unix_micros("captured_at"), F.lit(-(2**62)))).alias("at"), "signal_id")
    return x.groupBy("candidate_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(key)), lambda k: k["signal_id"]), "|").alias("evidence"))


# --- windows, sets, upkeep -----------------------------------------------------------------


@query(f"""WITH f AS (SELECT session_id, text, row_number() OVER (PARTITION BY session_id ORDER BY ts, path, uuid, text) AS rn FROM session_events
                      WHERE depth = 0 AND {KIND} = 'user_text' AND text IS NOT NULL AND ts IS NOT NULL AND uuid IS NOT NULL AND session_id IS NOT NULL),
           m AS (SELECT session_id, min(session_slug) AS slug FROM cowork_sessions WHERE session_id IS NOT NULL GROUP BY 1)
           SELECT f.session_id, length(text) AS first_chars, CASE WHEN slug <> '' AND left(trim(text), 200) <> '' THEN 'sha256:' || sha256('v1|' || slug || '|' || left(trim(text), 200)) END AS group_id
           FROM f LEFT JOIN m USING (session_id) WHERE rn = 1""")
def first_text_and_group(t: Tables) -> DataFrame:
    e = t.session_events.where((F.col("depth") == 0) & (label(F.col("kind")) == "user_text") & F.col("text").isNotNull() & F.col("ts").isNotNull() & F.col("uuid").isNotNull() & F.col("session_id").isNotNull())
    f = e.groupBy("session_id").agg(F.min(F.struct("ts", "path", "uuid", "text")).getField("text").alias("text"))
    m = t.cowork_sessions.where("session_id is not null").groupBy("session_id").agg(F.min("session_slug").alias("slug"))
    return f.join(m, "session_id", "left").select("session_id", F.length("text").cast("long").alias("first_chars"), X.continuation_group(F.col("slug"), F.col("text")).alias("group_id"))


@query("""WITH b AS (SELECT source_id, id, row_number() OVER (PARTITION BY source_id ORDER BY ingested_at, id) AS rn FROM capture_signals
                     WHERE source_id IS NOT NULL AND ingested_at >= TIMESTAMPTZ '2026-01-01 00:00:00+00'),
          old AS (SELECT source_id FROM capture_signals WHERE ingested_at < TIMESTAMPTZ '2026-01-01 00:00:00+00')
          SELECT source_id, id FROM b ANTI JOIN old USING (source_id) WHERE rn = 1""")
def idempotent_append(t: Tables) -> DataFrame:
    s = t.capture_signals
    at = F.lit("2026-01-01 00:00:00").cast("timestamp")
    return T.insert_if_absent(s.where(F.col("ingested_at") >= at), s.where(F.col("ingested_at") < at), "source_id", ["ingested_at", "id"], ["id"])


@query(f"""SELECT source_key, max(ingested_at) AS last_ingested_at FROM (SELECT {SOURCE} AS source_key, ingested_at FROM capture_signals) WHERE source_key IS NOT NULL GROUP BY 1""")
def checkpoint_upsert(t: Tables) -> DataFrame:
    """A checkpoint table of what came before 2026, after the rest was merged into it."""
    s = t.capture_signals.select(label(F.col("source")).alias("source_key"), F.col("ingested_at").alias("last_ingested_at"))
    at = F.lit("2026-01-01 00:00:00").cast("timestamp")
    old = s.where(F.col("last_ingested_at") < at).groupBy("source_key").agg(F.max("last_ingested_at").alias("last_ingested_at"))
    return T.upsert_max(old, s, "source_key", "last_ingested_at")


@query("""SELECT event_type, count(*) AS n, min(ts) AS first_ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY 1""")
def checkpoint_incremental(t: Tables) -> DataFrame:
    e = t.events
    x = T.since(e, "ts", now_of(e, "ts") - F.expr("INTERVAL 7 DAYS"))
    return x.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("ts").cast("timestamp_ntz").alias("first_ts"))


@query(f"""WITH {LATEST}, r AS (SELECT DISTINCT x.signal_id AS signal_id FROM (SELECT unnest(signal_exclusions) AS x FROM interview_sessions))
           SELECT signal_id, CASE WHEN signal_id IS NULL OR NOT regexp_matches(lower(signal_id), '^[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}$') THEN 'invalid'
                  WHEN latest.id IS NULL THEN 'not_found' WHEN coalesce(is_deleted, false) THEN 'already_deleted' ELSE 'ok' END AS outcome
           FROM r LEFT JOIN latest ON latest.id = r.signal_id""")
def soft_delete_outcomes(t: Tables) -> DataFrame:
    r = t.interview_sessions.select(F.explode("signal_exclusions").alias("x")).select(F.col("x.signal_id").alias("signal_id"))
    return T.soft_delete(r, "signal_id", latest_signals(t, "token_count"), "id", "is_deleted")


@query("""SELECT id, CASE WHEN status IN ('pending', 'awaiting_interview') AND created_at < TIMESTAMPTZ '2026-01-01 00:00:00+00' THEN 'archived' ELSE status END AS status FROM article_candidates""")
def guarded_status_update(t: Tables) -> DataFrame:
    guard = F.col("status").isin("pending", "awaiting_interview") & (F.col("created_at") < F.lit("2026-01-01 00:00:00").cast("timestamp"))
    return T.guarded_update(t.article_candidates, "status", guard, F.lit("archived")).select("id", "status")


@query("""SELECT id, len(coalesce(mcp, [])) + 1 AS n, list_extract(list_append(coalesce(mcp, []), 'audit'), -1) AS last FROM (SELECT session_id AS id, mcp_servers AS mcp FROM cowork_sessions)""")
def appended_entries(t: Tables) -> DataFrame:
    x = T.array_append(t.cowork_sessions, "mcp_servers", F.lit("audit"))
    return x.select(F.col("session_id").alias("id"), F.size("mcp_servers").cast("long").alias("n"), F.element_at("mcp_servers", -1).alias("last"))


@query("""SELECT id AS candidate_id, array_to_string(CASE WHEN len(serp_gaps) > 2 THEN list_slice(list_sort(serp_gaps), 1, 2) ELSE serp_gaps END, '|') AS asked FROM article_candidates WHERE serp_gaps IS NOT NULL""")
def gaps_to_ask(t: Tables) -> DataFrame:
    return t.article_candidates.where("serp_gaps is not null").select(F.col("id").alias("candidate_id"), F.array_join(A.first_alphabetical(F.col("serp_gaps")), "|").alias("asked"))


@query("""WITH d AS (SELECT source, doc_id FROM documents WHERE source IS NOT NULL), a AS (SELECT DISTINCT source FROM d), b AS (SELECT DISTINCT source FROM mix_targets)
          SELECT 'both' AS side, source FROM (SELECT source FROM a INTERSECT SELECT source FROM b)
          UNION ALL SELECT 'documents', source FROM (SELECT source FROM a EXCEPT SELECT source FROM b)
          UNION ALL SELECT 'targets', source FROM (SELECT source FROM b EXCEPT SELECT source FROM a)""")
def source_sets(t: Tables) -> DataFrame:
    a = t.documents.where("source is not null").select("source").distinct()
    b = t.mix_targets.select("source").distinct()

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.lit(name).alias("side"), "source")

    return side(a.intersect(b), "both").unionByName(side(a.subtract(b), "documents")).unionByName(side(b.subtract(a), "targets"))


# --- relational substrate ------------------------------------------------------------------


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
          FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY ALL""")
def pricing_summary(t: Tables) -> DataFrame:
    li = t.lineitem.where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"),
        F.count(F.lit(1)).alias("n"),
    )


@query("""SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n_lines
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def star_join_agg(t: Tables) -> DataFrame:
    """Revenue is first summed per order, so that few rows meet the dimension tables."""
    rev = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    per = t.lineitem.groupBy("l_orderkey").agg(F.sum(rev).alias("rev"), F.count(F.lit(1)).alias("lines"))
    x = per.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.sum("rev").alias("rev"), F.sum("lines").alias("lines"))
    x = x.join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return x.groupBy("r_name", "n_name").agg(F.round(F.sum("rev"), 2).alias("revenue"), F.sum("lines").alias("n_lines"))


@query("""SELECT c_mktsegment, o_orderkey, o_totalprice, CAST(rank AS INTEGER) AS rank FROM (
            SELECT c_mktsegment, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders JOIN customer ON o_custkey = c_custkey) WHERE rank <= 3""")
def top_orders_per_segment(t: Tables) -> DataFrame:
    x = t.orders.select("o_orderkey", "o_custkey", "o_totalprice").join(t.customer.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    w = Window.partitionBy("c_mktsegment").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return x.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("c_mktsegment", "o_orderkey", "o_totalprice", "rank")


@query("""SELECT event_type, window_start, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT event_type, value, time_bucket(INTERVAL 1 DAY, ts) AS window_start FROM events) GROUP BY ALL""")
def events_per_day(t: Tables) -> DataFrame:
    g = t.events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n", "total")
