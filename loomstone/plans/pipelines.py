"""Sources, sessions, ingestion, drafts and waits over whole tables.

Where an operator reads JSON, the JSON is made from the tables and the SQL states the result from the columns
themselves, so that both ways are independent.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.functions import arrays as A
from loomstone.functions import dates as D
from loomstone.functions import text as X
from loomstone.operators import drafts, ingest, redaction
from loomstone.operators import sessions as S
from loomstone.operators import tables as T
from loomstone.plans.common import Catalog, Tables, now_of
from loomstone.plans.relational import ALLOW, DENY, KIND, POST_CHECK, SOURCE, label
from loomstone.plans.texts import EMAIL, STRIPPED, sq
from loomstone.sources import files
from loomstone.streaming import sessions as waits

catalog = Catalog()
query = catalog.query

CLOSED = "('completed', 'skipped', 'timed_out')"


# --- paths and tools -----------------------------------------------------------------------


def _leaf(c):
    d = F.right(c, F.lit(1))
    return F.when(d.isin("1", "2"), "subagents/agent-acompact-1.jsonl").when(d == "3", "audit.jsonl").when(d == "4", "notes.txt").otherwise("main.jsonl")


_LEAF = "CASE WHEN right(workspace_id, 1) IN ('1', '2') THEN 'subagents/agent-acompact-1.jsonl' WHEN right(workspace_id, 1) = '3' THEN 'audit.jsonl' WHEN right(workspace_id, 1) = '4' THEN 'notes.txt' ELSE 'main.jsonl' END"


@query(f"""WITH p AS (SELECT session_id, workspace_id, session_slug, {_LEAF} AS leaf FROM cowork_sessions WHERE session_id IS NOT NULL AND workspace_id IS NOT NULL)
           SELECT session_id, workspace_id, session_slug, session_id AS folder_id, leaf LIKE '%.jsonl' AND leaf <> 'audit.jsonl' AS kept, leaf LIKE 'subagents/%' AS is_subagent, leaf LIKE '%agent-acompact-%' AS is_compact,
                  coalesce(session_slug, 'none') AS slug FROM p""")
def transcript_paths(t: Tables) -> DataFrame:
    """What the paths of transcripts say; the paths are made of the sessions' columns, with both kinds of slashes."""
    s = t.cowork_sessions.where("session_id is not null and workspace_id is not null")
    path = F.concat(F.lit("D:\\data\\"), "session_id", F.lit("\\projects\\w-sessions-"), F.coalesce("session_slug", F.lit("none")), F.lit("/"), _leaf(F.col("workspace_id")))
    c = X.transcript_class(path)
    return s.select("session_id", "workspace_id", "session_slug", X.workspace_of(path).alias("folder_id"), c["kept"].alias("kept"), c["is_subagent"].alias("is_subagent"), c["is_compact"].alias("is_compact"), c["slug"].alias("slug"))


_TOOLS = {"shell": "Bash", "mail_lookup": "mcp__mail__search", "write_file": "Write", "list_dir": "Glob", "fetch_url": "WebFetch", "search": "WebSearch", "read_file": "mcp__cowork__present_files"}


@query(f"""SELECT session_id, uuid, CASE WHEN tool = 'shell' AND length(summary) % 2 = 0 THEN 'bash (multi-line)' WHEN tool = 'write_file' AND length(summary) % 3 = 0 THEN NULL
                    ELSE nullif(substr({sq('summary')}, 1, 80), '') END AS summary
             FROM session_events WHERE tool IN ({', '.join(f"'{k}'" for k in _TOOLS)}) AND summary IS NOT NULL AND uuid IS NOT NULL""")
def tool_summaries(t: Tables) -> DataFrame:
    """Summaries from the payloads of tool calls: strings, lists of objects, blank lines and values that are no strings."""
    e = t.session_events.where(F.col("tool").isin(*_TOOLS) & F.col("summary").isNotNull() & F.col("uuid").isNotNull())
    names = F.create_map(*[F.lit(x) for kv in _TOOLS.items() for x in kv])
    s, n = F.col("summary"), F.length("summary")
    command = F.when(n % 2 == 0, F.concat(F.lit("\n"), s, F.lit("\n \npwd\n"))).otherwise(F.concat(s, F.lit("\n")))
    path = F.when(n % 3 == 0, F.to_json(F.struct(F.struct(s.alias("at")).alias("file_path")))).otherwise(F.to_json(F.struct(s.alias("file_path"))))
    payload = (
        F.when(F.col("tool") == "shell", F.to_json(F.struct(command.alias("command"))))
        .when(F.col("tool").isin("mail_lookup", "search"), F.to_json(F.struct(s.alias("query"))))
        .when(F.col("tool") == "write_file", path)
        .when(F.col("tool") == "list_dir", F.to_json(F.struct(s.alias("pattern"))))
        .when(F.col("tool") == "fetch_url", F.to_json(F.struct(s.alias("url"))))
        .when(F.col("tool") == "read_file", F.to_json(F.struct(F.array(F.struct(s.alias("file_path"))).alias("files"))))
    )
    return e.select("session_id", "uuid", X.tool_summary(names[F.col("tool")], payload).alias("summary"))


# --- transcripts ---------------------------------------------------------------------------


def _raw_lines(t: Tables) -> DataFrame:
    """Transcript lines as JSON, of the messages; those of one workspace's folder are broken too often."""
    e = t.session_events.where((F.col("depth") == 0) & F.col("session_id").isNotNull() & F.col("uuid").isNotNull() & F.col("ts").isNotNull() & F.col("path").isNotNull())
    n = F.col("path")[0]
    user = label(F.col("kind")) == "user_text"
    text = F.coalesce("text", F.lit(""))
    block = F.array(
        F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("input")),
        F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), F.lit("Read").alias("name"), F.col("uuid").alias("id"), F.to_json(F.struct(F.coalesce("cwd", F.lit("")).alias("file_path"), F.lit("Look around").alias("prompt"))).alias("input")),
        F.struct(F.lit("thinking").alias("type"), F.lit("-").alias("text"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("input")),
    )
    head = [F.when(user, "user").otherwise("assistant").alias("type"), D.iso_millis(F.col("ts")).alias("timestamp"), "uuid", (n % 7 == 6).alias("isMeta"), "cwd", F.col("git_branch").alias("gitBranch")]
    line = F.when(user, F.to_json(F.struct(*head, F.struct(text.alias("content")).alias("message")))).otherwise(F.to_json(F.struct(*head, F.struct(block.alias("content")).alias("message"))))
    bad = (F.col("cwd") == "/srv/work/monitor") & (n % 3 == 0)
    return e.select(F.coalesce("cwd", F.lit("-")).alias("path"), F.when(bad, F.lit("{broken")).otherwise(line).alias("value"))


_LINES = f"""l AS (SELECT coalesce(cwd, '-') AS path, uuid, cwd, path[1] % 7 = 6 AS meta, coalesce({KIND} = 'user_text', false) AS is_user, coalesce(text, '') AS text, cwd = '/srv/work/monitor' AND path[1] % 3 = 0 AS bad FROM session_events
              WHERE depth = 0 AND session_id IS NOT NULL AND uuid IS NOT NULL AND ts IS NOT NULL AND path IS NOT NULL),
          files AS (SELECT path, count(*) AS lines_read, count(*) FILTER (coalesce(bad, false)) AS lines_failed FROM l GROUP BY 1),
          good AS (SELECT l.* FROM l JOIN files USING (path) WHERE NOT coalesce(bad, false) AND lines_failed / lines_read <= 0.05)"""


@query(f"""WITH {_LINES} SELECT path, lines_read, lines_failed, lines_failed / lines_read > 0.05 AS abandoned FROM files""")
def transcript_files(t: Tables) -> DataFrame:
    """Lines read and broken of each file, and whether it is abandoned."""
    return files.parsed_lines(_raw_lines(t))[1]


@query(f"""WITH {_LINES} SELECT path, is_user, count(*) AS n FROM good WHERE NOT meta AND (NOT is_user OR trim(text, ' ') <> '') GROUP BY ALL""")
def transcript_kept_lines(t: Tables) -> DataFrame:
    """Lines that become events, by file and speaker."""
    lines, _ = files.parsed_lines(_raw_lines(t))
    return S.kept_lines(lines).groupBy("path", (F.col("type") == "user").alias("is_user")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_LINES}, a AS (SELECT * FROM good WHERE NOT meta AND NOT is_user)
           SELECT uuid, 'assistant_text' AS kind, text, CAST(NULL AS VARCHAR) AS summary FROM a WHERE trim(text, ' ') <> ''
           UNION ALL SELECT uuid || '#1', 'tool_call', NULL, nullif(substr({sq("coalesce(cwd, '')")}, 1, 80), '') FROM a""")
def transcript_blocks(t: Tables) -> DataFrame:
    """Assistants' lines as one event per text or tool-use block."""
    lines, _ = files.parsed_lines(_raw_lines(t))
    return S.explode_blocks(S.kept_lines(lines)).select("uuid", "kind", "text", "summary")


@query("""WITH p AS (SELECT session_id, path, parent_tool_use_id AS tool_use_id, uuid, row_number() OVER (PARTITION BY session_id, path ORDER BY uuid) AS rn FROM session_events WHERE subagent_slug IS NOT NULL AND uuid IS NOT NULL AND parent_tool_use_id IS NOT NULL AND path IS NOT NULL),
          c AS (SELECT session_id, list_slice(path, 1, len(path) - 1) AS up, min(text) AS t FROM session_events WHERE depth > 0 AND text <> '' GROUP BY ALL),
          x AS (SELECT p.session_id, path[1] AS ord, tool_use_id, uuid, t FROM p JOIN c ON c.session_id = p.session_id AND c.up = p.path WHERE rn = 1 AND len(path) = 1),
          d AS (SELECT *, row_number() OVER (PARTITION BY session_id, substr(t, 1, 80) ORDER BY ord, tool_use_id) AS r FROM x),
          s AS (SELECT *, row_number() OVER (PARTITION BY session_id, substr(t, 1, 80) ORDER BY ord, uuid) AS r FROM x)
          SELECT s.session_id, d.tool_use_id, s.uuid AS subagent_id FROM s JOIN d ON d.session_id = s.session_id AND substr(d.t, 1, 80) = substr(s.t, 1, 80) AND d.r = s.r""")
def stitched_subagents(t: Tables) -> DataFrame:
    """Dispatch calls met with the subagents they began, by the beginning of their first text."""
    e = t.session_events
    p = e.where("subagent_slug is not null and uuid is not null and parent_tool_use_id is not null and size(path) = 1").groupBy("session_id", "path").agg(F.min(F.struct("uuid", F.col("parent_tool_use_id").alias("tool_use_id"))).alias("m"))
    c = e.where("depth > 0 and text <> ''").groupBy("session_id", F.slice("path", 1, F.size("path") - 1).alias("path")).agg(F.min("text").alias("t"))
    x = p.join(c, ["session_id", "path"]).select("session_id", F.col("path")[0].alias("ord"), "m.uuid", "m.tool_use_id", "t")
    return S.stitch(x.select("session_id", "ord", "tool_use_id", F.concat("t", F.lit(" and report back")).alias("prompt")), x.select("session_id", "ord", F.col("uuid").alias("subagent_id"), F.col("t").alias("first_text")))


@query("""WITH c AS (SELECT workspace_id AS session_id, session_slug AS slug, title AS first_text, model IS NULL AS stripped, dense_rank() OVER (PARTITION BY workspace_id ORDER BY session_id) AS ord FROM cowork_sessions WHERE workspace_id IS NOT NULL AND session_id IS NOT NULL),
          o AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS n, min(CASE WHEN NOT stripped THEN ord END) OVER (PARTITION BY session_id) AS first_ord FROM c),
          g AS (SELECT session_id, min(slug) AS slug, min(first_text) AS first_text FROM o WHERE ord = first_ord AND NOT stripped GROUP BY 1)
          SELECT o.session_id, CAST(o.ord AS INTEGER) AS ord, CASE WHEN o.n >= 2 AND g.slug <> '' AND substr(trim(g.first_text), 1, 200) <> '' THEN 'sha256:' || sha256('v1|' || g.slug || '|' || substr(trim(g.first_text), 1, 200)) END AS continuation_group_id
          FROM o LEFT JOIN g USING (session_id)""")
def continuation_chains(t: Tables) -> DataFrame:
    """Transcripts of one chain share the id of their original."""
    s = t.cowork_sessions.where("workspace_id is not null and session_id is not null")
    from pyspark.sql import Window

    w = Window.partitionBy("workspace_id").orderBy("session_id")
    x = s.select(F.col("workspace_id").alias("session_id"), F.col("session_slug").alias("slug"), F.dense_rank().over(w).alias("ord"), F.col("title").alias("first_text"), F.col("model").isNull().alias("stripped"))
    return S.chain_groups(x).select("session_id", "ord", "continuation_group_id")


# --- session filters and export ------------------------------------------------------------

_SESSIONS = f"""e AS (SELECT session_id, count(*) AS n, arg_min(cwd, (ts, path, uuid)) FILTER (cwd IS NOT NULL AND ts IS NOT NULL AND uuid IS NOT NULL AND path IS NOT NULL) AS cwd,
                             arg_min(text, (ts, path, uuid)) FILTER (depth = 0 AND {KIND} = 'user_text' AND text IS NOT NULL AND ts IS NOT NULL AND uuid IS NOT NULL AND path IS NOT NULL) AS first_text
                      FROM session_events WHERE session_id IS NOT NULL GROUP BY 1),
          m AS (SELECT session_id, min(session_slug) AS slug FROM cowork_sessions WHERE session_id IS NOT NULL GROUP BY 1),
          s AS (SELECT coalesce(e.session_id, m.session_id) AS session_id, coalesce(n, 0) AS n, coalesce(slug, '') LIKE 'a%' AS slug_blocked, first_text, m.session_id IS NULL AS meta_missing, rtrim(lower(cwd), '/') AS cwd FROM e FULL JOIN m ON e.session_id = m.session_id),
          early AS (SELECT session_id, CASE WHEN n = 0 THEN 'no_transcripts' WHEN slug_blocked THEN 'slug_blocked' WHEN starts_with(first_text, '<scheduled-task') THEN 'scheduled_task' WHEN starts_with(first_text, '<command-message') THEN 'command_message'
                           WHEN starts_with(first_text, '<system-path-cwd') THEN 'system_path_cwd' WHEN meta_missing THEN 'meta_missing' WHEN starts_with(cwd, '/srv/work/monitor') THEN 'cwd_always_deny'
                           WHEN cwd <> '' AND NOT starts_with(cwd, '/srv/work') THEN 'cwd_not_allowed' END AS reason FROM s)"""


def _sessions(t: Tables) -> DataFrame:
    e = t.session_events.where("session_id is not null")
    at = F.struct("ts", "path", "uuid")
    ordered = F.col("ts").isNotNull() & F.col("uuid").isNotNull() & F.col("path").isNotNull()
    user = (F.col("depth") == 0) & (label(F.col("kind")) == "user_text") & F.col("text").isNotNull() & ordered
    g = e.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n_transcripts"),
        F.min_by("cwd", F.when(F.col("cwd").isNotNull() & ordered, at)).alias("cwd"),
        F.min_by("text", F.when(user, at)).alias("first_text"),
    )
    m = t.cowork_sessions.where("session_id is not null").groupBy("session_id").agg(F.min("session_slug").alias("slug"), F.lit(False).alias("no_meta"))
    x = g.join(m, "session_id", "full")
    return x.select("session_id", F.coalesce("n_transcripts", F.lit(0)).alias("n_transcripts"), F.coalesce("slug", F.lit("")).startswith("a").alias("slug_blocked"), "first_text", F.coalesce("no_meta", F.lit(True)).alias("meta_missing"), "cwd")


@query(f"WITH {_SESSIONS} SELECT session_id, reason AS drop_reason FROM early")
def filter_cascade(t: Tables) -> DataFrame:
    """The first reason to drop each session before its events are read."""
    reason = S.keep_or_drop(F.col("n_transcripts"), F.col("slug_blocked"), F.col("first_text"), F.col("meta_missing"), F.col("cwd"), ALLOW, DENY)
    return _sessions(t).select("session_id", reason.alias("drop_reason"))


_RAW_KIND = "kind IN ('user_text', 'assistant_text')"
_AUDIT = f"""{_SESSIONS}, {POST_CHECK.replace(f"{KIND} IN ('user_text', 'assistant_text')", _RAW_KIND)},
             audit AS (SELECT early.session_id, CASE WHEN early.reason IS NOT NULL THEN early.reason WHEN verdict.session_id IS NULL THEN 'tiny_session' ELSE verdict.drop_reason END AS drop_reason FROM early LEFT JOIN verdict USING (session_id))"""


@query(f"WITH {_AUDIT} SELECT * FROM audit")
def export_audit(t: Tables) -> DataFrame:
    """The verdict on every session, before and after its events are read."""
    return S.export(_sessions(t), t.session_events, ALLOW, DENY, lambda c: c)[1]


@query(f"""WITH {_AUDIT} SELECT session_id, uuid, regexp_replace(text, '{EMAIL}', '[REDACTED_EMAIL]', 'g') AS text, substr(regexp_replace(summary, '{EMAIL}', '[REDACTED_EMAIL]', 'g'), 1, 80) AS summary
           FROM session_events SEMI JOIN (SELECT session_id FROM audit WHERE drop_reason IS NULL) k USING (session_id)""")
def export_events(t: Tables) -> DataFrame:
    """Events of the kept sessions, all their texts redacted."""
    red, _ = S.export(_sessions(t), t.session_events, ALLOW, DENY, lambda c: F.regexp_replace(c, EMAIL, "[REDACTED_EMAIL]"))
    return red.select("session_id", "uuid", "text", "summary")


# --- documents -----------------------------------------------------------------------------

_OK = "kind IN ('user_text', 'assistant_text', 'tool_call', 'subagent') AND ts IS NOT NULL AND uuid IS NOT NULL AND path IS NOT NULL AND session_id IS NOT NULL AND (kind NOT IN ('user_text', 'assistant_text') OR text <> '') AND (kind <> 'tool_call' OR tool <> '')"


@query(f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY session_id, path ORDER BY uuid, kind) AS rn FROM session_events WHERE {_OK}),
           one AS (SELECT session_id, path, depth, kind, uuid, ts FROM e WHERE rn = 1 AND session_id IN (SELECT session_id FROM cowork_sessions)),
           a AS (SELECT * FROM one WHERE depth = 0),
           b AS (SELECT one.* FROM one SEMI JOIN a ON a.session_id = one.session_id AND a.kind = 'subagent' AND a.path = list_slice(one.path, 1, len(one.path) - 1) WHERE depth = 1),
           c AS (SELECT one.* FROM one SEMI JOIN b ON b.session_id = one.session_id AND b.kind = 'subagent' AND b.path = list_slice(one.path, 1, len(one.path) - 1) WHERE depth = 2)
           SELECT session_id, depth, kind, uuid, date_trunc('milliseconds', ts) AS ts FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)""")
def documents_round_trip(t: Tables) -> DataFrame:
    """Sessions written as JSON documents with their event trees, judged strictly, and flattened again."""
    e = t.session_events.where(_OK)
    one = e.groupBy("session_id", "path").agg(F.min(F.struct("uuid", "kind", "depth", "ts", "text", "tool", "summary", "subagent_slug", "parent_tool_use_id", "cwd", "git_branch")).alias("m")).select("session_id", "path", "m.*")
    one = one.withColumn("summary", F.substring("summary", 1, 80))
    s = t.cowork_sessions.where("session_id is not null").groupBy("session_id").agg(F.max(F.struct("created_at", "session_slug", "workspace_id", "title", "last_activity_at", "model", "account", "mcp_servers")).alias("m")).select("session_id", "m.*")
    docs = files.build_documents(s, one.join(s.select("session_id"), "session_id", "left_semi"), max_depth=2)
    good = files.judged(docs.select(F.col("session_id").alias("path"), "doc"))
    return files.flat_events(good, 3).select("session_id", "depth", "kind", "uuid", "ts")


@query("""SELECT session_id, title, account, model, created_at, CASE WHEN session_slug LIKE '%a%' THEN last_activity_at ELSE date_trunc('milliseconds', last_activity_at) END AS last_activity_at, coalesce(len(list_filter(mcp_servers, lambda s: s <> '')), 0) AS n_servers
          FROM (SELECT session_id, title, nullif(account, '') AS account, nullif(model, '') AS model, date_trunc('milliseconds', created_at) AS created_at, session_slug, date_trunc('milliseconds', last_activity_at) AS last_activity_at, mcp_servers FROM cowork_sessions)""")
def side_files(t: Tables) -> DataFrame:
    """Sessions' side files read back: times as milliseconds or ISO text."""
    s = t.cowork_sessions
    servers = F.transform("mcp_servers", lambda x: F.struct(x.alias("name")))
    payload = F.to_json(F.struct(
        F.col("session_id").alias("sessionId"), "title", F.col("account").alias("accountName"), "model", F.unix_millis("created_at").alias("createdAt"), D.iso_millis(F.col("last_activity_at")).alias("lastActivityAt"), servers.alias("mcpServers"),
    ))
    x = files.session_meta(s.select(payload.alias("payload")), "payload")
    return x.select("session_id", "title", "account", "model", "created_at", "last_activity_at", F.coalesce(F.size("mcp_servers"), F.lit(0)).cast("long").alias("n_servers"))


# --- ingestion -----------------------------------------------------------------------------

BLOCKED = ["carol@x.example"]
KEYWORD = "password vault"

_MESSAGES = f"""msg AS (SELECT id, CASE WHEN token_count % 5 = 0 THEN 'html' ELSE 'text' END AS body_type, redacted_text AS text, is_deleted AS is_draft, captured_at, ingested_at,
                  CASE WHEN token_count % 11 = 0 THEN 'carol@x.example' ELSE 'dave@x.example' END AS sender, CASE WHEN token_count % 13 = 0 THEN 'Salary talk' ELSE 'Notes' END AS subject
                FROM capture_signals WHERE {SOURCE} = 'msgraph_email')"""


def _messages(t: Tables) -> DataFrame:
    s = t.capture_signals.where(label(F.col("source")) == "msgraph_email")
    n = F.col("token_count")
    return s.select(
        "id", "ingested_at", F.col("is_deleted").alias("is_draft"), F.when(n % 5 == 0, "html").otherwise("text").alias("body_type"), F.col("redacted_text").alias("body"),
        F.when(n % 11 == 0, "Carol@X.example ").otherwise("dave@x.example").alias("sender"), F.when(n % 13 == 0, "Salary talk").otherwise("Notes").alias("subject"),
        F.array().cast("array<string>").alias("recipients"), F.when(n % 2 == 0, D.iso_millis(F.col("captured_at"))).otherwise("not a time").alias("sent_at"), F.when(n % 7 != 0, D.iso_millis(F.col("captured_at"))).alias("received_at"),
    )


@query(f"""WITH {_MESSAGES.replace('captured_at, ingested_at', "CASE WHEN token_count % 2 = 0 OR token_count % 7 <> 0 THEN captured_at END AS captured_at, ingested_at, token_count")},
           b AS (SELECT *, CASE WHEN body_type = 'html' THEN {sq(STRIPPED)} ELSE trim(text, ' ') END AS body FROM msg)
           SELECT CASE WHEN coalesce(is_draft, false) THEN 'skipped_draft' WHEN coalesce(id, '') = '' THEN 'failed' WHEN coalesce(body, '') = '' THEN 'skipped_empty' WHEN captured_at IS NULL THEN 'failed' ELSE 'ready' END AS status,
                  count(*) AS n, count(DISTINCT id) AS n_ids FROM b GROUP BY 1""")
def message_statuses(t: Tables) -> DataFrame:
    """What becomes of each message of a mailbox: drafts, empty bodies, unreadable times."""
    return ingest.message_status(_messages(t)).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("n_ids"))


@query(f"""WITH {_MESSAGES} SELECT DISTINCT id, sender, subject, CASE WHEN sender = 'carol@x.example' THEN 'sender' WHEN subject = 'Salary talk' THEN 'subject' WHEN contains(lower(text), '{KEYWORD}') THEN 'keyword' END AS block_reason,
             CASE WHEN sender = 'carol@x.example' OR subject = 'Salary talk' OR contains(lower(text), '{KEYWORD}') THEN 'blocked' ELSE 'redacted' END AS status FROM msg""")
def redaction_outcomes(t: Tables) -> DataFrame:
    """Blocked and flowing messages: blocked ones have neither text nor log."""
    hashes = [hashlib.sha256(b.encode()).hexdigest() for b in BLOCKED]
    m = _messages(t)
    reason = redaction.block_reason(F.col("sender"), F.col("recipients"), F.col("subject"), F.col("body"), hashes, r"\bsalary\b", [KEYWORD])
    r = redaction.redact(m, "body", reason)
    closed = F.when((F.col("status") == "blocked") & ((F.col("redacted_text") != "") | (F.size("redaction_log") > 0)), "leak").otherwise(F.col("status"))
    return r.select("id", F.trim(F.lower("sender")).alias("sender"), "subject", "block_reason", closed.alias("status")).distinct()


@query(f"""SELECT DISTINCT id AS session_id, created_at FROM interview_sessions WHERE status NOT IN {CLOSED} AND NOT reminder_sent
             AND epoch_us((SELECT max(created_at) FROM interview_sessions)) - epoch_us(created_at) >= 48 * 3600000000""")
def reminders_due(t: Tables) -> DataFrame:
    """Open sessions that have waited two days for a reminder."""
    s = t.interview_sessions
    still = s.where(~F.col("status").isin("completed", "skipped", "timed_out") & ~F.col("reminder_sent"))
    return ingest.due(still, "created_at", 48, now_of(s, "created_at")).select(F.col("id").alias("session_id"), "created_at").distinct()


@query("""WITH c AS (SELECT DISTINCT id, cluster_label, status, len(signal_ids) AS n_signals FROM synthesis_clusters WHERE id IS NOT NULL)
          SELECT id, cluster_label, n_signals, 'active' AS list, CAST(NULL AS VARCHAR) AS reason FROM c WHERE n_signals >= 5 AND cluster_label <> ''
          UNION ALL SELECT id, cluster_label, n_signals, 'discarded', CASE WHEN coalesce(cluster_label, '') = '' THEN 'no label' ELSE 'too small' END FROM c WHERE n_signals IS NULL OR n_signals < 5 OR coalesce(cluster_label, '') = ''""")
def cluster_rows(t: Tables) -> DataFrame:
    """Clusters to store and those to discard, with the reason, in one table."""
    c = t.synthesis_clusters.where("id is not null").select("id", "cluster_label", "status", F.when(F.col("signal_ids").isNotNull(), F.size("signal_ids")).cast("long").alias("n_signals")).distinct()
    reason = F.when(F.coalesce("cluster_label", F.lit("")) == "", "no label").when(F.coalesce("n_signals", F.lit(0)) < 5, "too small")
    kept, gone = T.with_discards(c, reason)
    cols = ["id", "cluster_label", "n_signals", "list", "reason"]
    return kept.withColumn("list", F.lit("active")).select(cols).unionByName(gone.withColumn("list", F.lit("discarded")).select(cols))


# --- answers, drafts -----------------------------------------------------------------------


@query("""SELECT id, created_at, array_to_string(list_filter(list_transform(answers, lambda a: CAST(a.question_index + 1 AS VARCHAR) || CASE a.response WHEN 'yes' THEN ':yes' WHEN 'anon' THEN ':anon' WHEN 'skip' THEN ':skip' END), lambda x: x IS NOT NULL), '|') AS choices
          FROM interview_sessions WHERE answers IS NOT NULL""")
def button_choices(t: Tables) -> DataFrame:
    """Pressed buttons read from their payloads; anything else is none."""
    short = F.create_map(*[F.lit(x) for x in ("yes", "y", "anon", "a", "skip", "s", "answered", "q")])

    def choice(a):
        c = A.callback(F.concat(F.lit("cnfm:"), (a["question_index"] + 1).cast("string"), F.lit(":"), short[a["response"]]))
        return F.concat(c["question_index"].cast("string"), F.lit(":"), c["choice"])

    s = t.interview_sessions.where("answers is not null")
    return s.select("id", "created_at", F.array_join(F.filter(F.transform("answers", choice), lambda x: x.isNotNull()), "|").alias("choices"))


@query("""SELECT id, created_at, CASE WHEN status IN ('completed', 'skipped', 'timed_out') THEN status WHEN len(coalesce(questions, [])) = 0 THEN 'waiting_for_questions'
                 WHEN len(list_filter(coalesce(answers, []), lambda a: a.response IS NOT NULL)) < len(questions) THEN 'asking' ELSE 'follow_up' END AS phase FROM interview_sessions""")
def interview_phases(t: Tables) -> DataFrame:
    """Where each interview stands, from its questions and answers."""
    s = t.interview_sessions
    answered = F.size(F.filter(F.coalesce("answers", F.array().cast(s.schema["answers"].dataType)), lambda a: a["response"].isNotNull()))
    n = F.coalesce(F.size(F.coalesce("questions", F.array().cast(s.schema["questions"].dataType))), F.lit(0))
    phase = F.when(F.col("status").isin("completed", "skipped", "timed_out"), F.col("status")).when(n == 0, "waiting_for_questions").when(answered < n, "asking").otherwise("follow_up")
    return s.select("id", "created_at", phase.alias("phase"))


@query("""SELECT id, created_at, array_to_string(p, chr(10)) AS prose, substr(array_to_string(p, chr(10) || '---' || chr(10)), 1, 300) AS joined FROM
            (SELECT id, created_at, list_filter(list_transform(answers, lambda a: trim(coalesce(a.transcript, a.text, ''), ' ')), lambda x: x <> '') AS p FROM interview_sessions WHERE answers IS NOT NULL)""")
def answers_prose(t: Tables) -> DataFrame:
    """What was said in each interview, and its beginning joined for a prompt."""
    p = drafts.prose(F.col("answers"))
    return t.interview_sessions.where("answers is not null").select("id", "created_at", F.array_join(p, "\n").alias("prose"), drafts.joined(p, 300).alias("joined"))


@query("""SELECT id, created_at, array_to_string(list_transform(list_filter(signal_exclusions, lambda x: x.signal_id IS NOT NULL AND x.reason IS NOT NULL), lambda x: '- ' || x.signal_id || ': ' || x.reason), chr(10)) AS lines FROM interview_sessions WHERE signal_exclusions IS NOT NULL""")
def exclusion_lines(t: Tables) -> DataFrame:
    s = t.interview_sessions.where("signal_exclusions is not null")
    pairs = F.transform("signal_exclusions", lambda x: F.struct(x["signal_id"].alias("rule_id"), x["reason"].alias("instruction")))
    return s.select("id", "created_at", X.correction_lines(pairs).alias("lines"))


TITLE = {"Half": r"(?i)(?<!\w)half(?!\w)", "Nobody": r"(?i)(?<!\w)nobody(?!\w)", "Number": r"(?<!\w)\d{3,}(?!\w)"}


@query(rf"""WITH d AS (SELECT doc_id, text, split_part(text, chr(10), 1) AS title, len(list_filter(string_split({sq('text')}, ' '), lambda w: w <> '')) AS n FROM documents WHERE text IS NOT NULL),
            f AS (SELECT doc_id, CASE WHEN n < 100 THEN 'words' END AS a,
                         CASE WHEN regexp_matches(title, '(?i)\bhalf\b') OR regexp_matches(title, '(?i)\bnobody\b') OR regexp_matches(title, '\b\d{{3,}}\b') THEN 'title' END AS b,
                         CASE WHEN NOT (regexp_matches(text, '\bI\b') OR regexp_matches(text, '(?i)\bwe\b') OR regexp_matches(text, '(?i)\bmy client\b') OR regexp_matches(text, '(?i)\bin my experience\b')) THEN 'voice' END AS c FROM d)
            SELECT doc_id, coalesce(a, b, c) AS first_rule, concat_ws(',', a, b, c) AS all_rules FROM f""")
def draft_failures(t: Tables) -> DataFrame:
    """The first rule each draft breaks, and all of them."""
    c = F.col("text")
    first = F.element_at(F.split(c, "\n"), 1)
    checks = [("words", drafts.few_words(F.array(c), 100)), ("title", drafts.title_words(first, TITLE)), ("voice", drafts.no_first_person(c))]
    return t.documents.where("text is not null").select("doc_id", drafts.first_failure(checks)["rule_id"].alias("first_rule"), F.array_join(drafts.all_failures(checks), ",").alias("all_rules"))


_NUM = r"\b\d[\d,]*(?:\.\d+)?\b"


@query(rf"""WITH d AS (SELECT doc_id, text, regexp_extract_all(text, '{_NUM}') AS toks, regexp_split_to_array(text, '{_NUM}') AS parts FROM documents WHERE text IS NOT NULL),
            e AS (SELECT doc_id, text, toks, parts, unnest(range(1, len(toks) + 1)) AS i FROM d),
            o AS (SELECT doc_id, text, toks[i] AS tok, i, CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(toks[1:i - 1], lambda x: length(x))), 0) AS INTEGER) AS pos FROM e),
            w AS (SELECT doc_id, tok, i, pos, substr(text, greatest(pos - 200, 0) + 1, length(tok) + 200 + least(pos, 200)) AS near FROM o WHERE length(regexp_replace(tok, '[^0-9]', '', 'g')) >= 4),
            f AS (SELECT doc_id, arg_min(pos, i) AS pos, arg_min(tok, i) AS tok FROM w WHERE NOT regexp_matches(near, '(?i)(https?://|www\.)\S')
                    AND NOT regexp_matches(near, '(?i)\b(?:source|according to|per|study|survey|report|research|data from|cited|citation|reference|statista|gartner|forrester)\b') GROUP BY 1)
            SELECT doc_id, f.pos AS pos, f.tok AS number FROM d LEFT JOIN f USING (doc_id)""")
def unsourced_numbers(t: Tables) -> DataFrame:
    """The first number of each document that no source stands near."""
    n = drafts.unattributed_number(F.col("text"))
    return t.documents.where("text is not null").select("doc_id", n["offset"].alias("pos"), n["number"].alias("number"))


@query(r"""WITH h AS (SELECT doc_id, text, substr(text, 1, 200) AS head FROM documents WHERE text IS NOT NULL),
           c AS (SELECT *, length(regexp_extract(head, '(?s)^(.*[.!?]) ', 1)) AS s, length(regexp_extract(head, '(?s)^(.*) ', 1)) AS b FROM h)
           SELECT doc_id, CASE WHEN length(text) <= 200 THEN text WHEN s > 100 THEN substr(head, 1, s) WHEN b > 0 THEN substr(head, 1, b) ELSE head END AS cut FROM c""")
def cut_texts(t: Tables) -> DataFrame:
    return t.documents.where("text is not null").select("doc_id", X.cut_at_boundary(F.col("text"), 200).alias("cut"))


@query(r"""WITH p AS (SELECT doc_id, substr(text, 1, instr(lower(text), 'the ') - 1) AS head FROM documents WHERE contains(lower(text), 'the ')),
           q AS (SELECT doc_id, regexp_split_to_array(head, '\n\s*\n') AS ps FROM p)
           SELECT doc_id, 'paragraph ' || len(ps) || ', sentence ' || (1 + len(regexp_extract_all(ps[-1], '[.!?]\s+'))) AS place FROM q""")
def phrase_places(t: Tables) -> DataFrame:
    """The paragraph and sentence of a phrase."""
    at = F.instr(F.lower("text"), "the ")
    return t.documents.where(at > 0).select("doc_id", X.place_of(F.col("text"), at - 1).alias("place"))


@query("""SELECT event_id, props AS inside, CASE WHEN event_id % 4 = 3 THEN NULL ELSE ts END AS happened_at, event_id % 4 = 1 AS is_iso, least(250.0 * power(2, event_id % 12), 60000.0) AS wait_ms, 'key *** of ' || event_type AS scrubbed
          FROM (SELECT event_id, props, event_type, date_trunc('milliseconds', ts) AS ts FROM events)""")
def wire_values(t: Tables) -> DataFrame:
    """Values as they come over a wire: fenced JSON, times in two forms or none, waits that double, secrets."""
    e, n = t.events, F.col("event_id") % 4
    fenced = F.when(n == 0, F.col("props")).otherwise(F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```\nDone.")))
    at = F.when(n == 3, "soon").when(n == 1, D.iso_millis(F.col("ts"))).otherwise(F.unix_millis("ts").cast("string"))
    secret = F.concat(F.lit("key s3cret of "), "event_type")
    return e.select("event_id", X.fenced_json(fenced).alias("inside"), D.any_timestamp(at).cast("timestamp_ntz").alias("happened_at"), D.is_iso_millis(at).alias("is_iso"), D.backoff_ms(250, F.col("event_id") % 12, 60_000).alias("wait_ms"), X.without_secret(secret, "s3cret").alias("scrubbed"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN NULL ELSE event_type END AS label, event_id % 3 = 0 AS strings,
                 CASE WHEN event_id % 4 = 0 THEN 1 ELSE 2 END AS n_addresses, event_id % 2 = 0 AS entities_ok FROM events""")
def answer_bounds(t: Tables) -> DataFrame:
    """Answers of providers held against their bounds: labels, lists of strings, entities; and mail addresses."""
    n = F.col("event_id")
    words = F.when(n % 5 == 0, F.array(F.lit(""))).when(n % 5 == 1, F.array_repeat(F.lit("w"), 9)).otherwise(F.array(F.lit("w"), F.col("event_type")))
    payload = F.to_json(F.struct(F.col("event_type").alias("label"), words.alias("topicKeywords")))
    strings = F.when(n % 3 == 0, F.lit('["a","b"]')).when(n % 3 == 1, F.lit('["a",1]')).otherwise(F.lit("{"))
    address = F.struct(F.struct(F.lit("n").alias("name"), F.when(n % 4 != 0, F.lit("a@x.example")).alias("address")).alias("emailAddress"))
    other = F.struct(F.struct(F.lit("n").alias("name"), F.lit("b@x.example").alias("address")).alias("emailAddress"))
    entity = F.struct(F.lit("email").alias("type"), F.lit(0).alias("offset"), F.when(n % 2 == 0, F.length("event_type")).otherwise(F.length("event_type") + 1).alias("length"))
    return t.events.select("event_id", A.valid_label(payload)["label"].alias("label"), A.all_strings(strings).alias("strings"), F.size(A.addresses(F.array(address, other))).alias("n_addresses"), A.valid_entities(F.col("event_type"), F.array(entity)).alias("entities_ok"))


# --- waits ---------------------------------------------------------------------------------


@query("""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS key, epoch_us(ts) // 1000 AS ms, ts, CASE event_type WHEN 'view' THEN 'asked' WHEN 'purchase' THEN 'reply' WHEN 'error' THEN 'skip' ELSE event_type END AS name, CAST(event_id AS VARCHAR) AS ref, props AS text FROM events),
          n AS (SELECT *, lead(ms) OVER w AS nms, lead(name) OVER w AS nname, lead(text) OVER w AS ntext FROM e WHERE name IN ('asked', 'reply', 'skip') WINDOW w AS (PARTITION BY key ORDER BY ts, name, ref)),
          l AS (SELECT key, max(ms) AS last FROM e GROUP BY 1),
          o AS (SELECT n.*, last, ms + 604800000 AS until, coalesce(nms <= ms + 604800000, false) AS met FROM n JOIN l USING (key) WHERE name = 'asked')
          SELECT key, ref, CASE WHEN NOT met THEN 'timeout' WHEN nname = 'asked' THEN 'superseded' WHEN nname = 'reply' THEN 'replied' ELSE 'skipped' END AS outcome,
                 make_timestamp(CASE WHEN met THEN nms ELSE until END * 1000) AS decided_at, CASE WHEN met AND nname = 'reply' THEN ntext END AS text FROM o WHERE met OR last > until""")
def replayed_waits(t: Tables) -> DataFrame:
    """Questions and what became of them within seven days: answered, skipped, replaced or timed out."""
    e = t.events
    name = F.when(F.col("event_type") == "view", "asked").when(F.col("event_type") == "purchase", "reply").when(F.col("event_type") == "error", "skip").otherwise(F.col("event_type"))
    x = waits.replay(e.select(F.col("user_id").cast("string").alias("key"), "ts", name.alias("name"), F.col("event_id").cast("string").alias("ref"), F.col("props").alias("text")))
    return x.select("key", "ref", "outcome", F.col("at").cast("timestamp_ntz").alias("decided_at"), "text")


# --- payloads, replies, gates ---------------------------------------------------------------


@query("""WITH q AS (SELECT id, unnest(questions) AS q FROM interview_sessions WHERE questions IS NOT NULL), x AS (SELECT id, q.index AS n, q.question_text AS question_text, q.signal_id AS signal_id, q.question_type AS question_type FROM q)
          SELECT DISTINCT id, n, CASE WHEN n % 4 = 1 OR question_text IS NULL OR coalesce(signal_id, '') = '' OR coalesce(question_type, '') NOT IN ('confirmation', 'fallback') THEN NULL ELSE question_text END AS question_text FROM x""")
def typed_payloads(t: Tables) -> DataFrame:
    """Answers of providers as typed objects, or nothing where any field is not what it must be."""
    q = t.interview_sessions.where("questions is not null").select("id", F.explode("questions").alias("q")).select("id", F.col("q.index").alias("n"), "q.question_text", "q.signal_id", "q.question_type")
    good = F.to_json(F.struct("question_text", "signal_id", "question_type", F.array(F.lit("a")).alias("specifics"), F.lit(True).alias("none")))
    bad = F.to_json(F.struct("question_text", "signal_id", "question_type", F.array(F.lit(1)).alias("specifics"), F.lit(True).alias("none")))
    v = A.typed_object(F.when(F.col("n") % 4 == 1, bad).otherwise(good), {"question_text": "string", "signal_id": "text", "question_type": ["confirmation", "fallback"], "specifics": "strings", "none": "boolean"})
    return q.select("id", "n", v["question_text"].alias("question_text")).distinct()


@query("""WITH a AS (SELECT id, unnest(answers) AS a FROM interview_sessions WHERE answers IS NOT NULL),
          r AS (SELECT id, a.question_index AS n, a.response AS choice, a.text AS text, a.transcript AS transcript, a.audio_url AS audio_url, CASE WHEN a.response = 'answered' AND a.audio_url IS NOT NULL THEN 'voice' WHEN a.response = 'answered' THEN 'text' ELSE 'callback' END AS kind FROM a)
          SELECT DISTINCT id, n, CASE WHEN kind = 'callback' AND choice IS NOT NULL THEN choice WHEN kind = 'voice' AND transcript IS NULL THEN NULL WHEN kind = 'voice' THEN 'voice' ELSE 'text' END AS response,
                 CASE WHEN kind = 'callback' AND choice IS NOT NULL THEN NULL WHEN kind = 'voice' THEN transcript ELSE text END AS said, kind = 'callback' AND coalesce(choice IN ('yes', 'anon'), false) AS confirms, kind = 'voice' AND transcript IS NULL AS needs_text FROM r""")
def reply_records(t: Tables) -> DataFrame:
    """Replies by button, voice and text in one form."""
    a = t.interview_sessions.where("answers is not null").select("id", F.explode("answers").alias("a"))
    kind = F.when((F.col("a.response") == "answered") & F.col("a.audio_url").isNotNull(), "voice").when(F.col("a.response") == "answered", "text").otherwise("callback")
    r = A.reply_record(kind, F.col("a.response"), F.col("a.text"), F.col("a.transcript"), F.col("a.audio_url"))
    return a.select("id", F.col("a.question_index").alias("n"), r.alias("r")).select("id", "n", "r.response", F.col("r.text").alias("said"), "r.confirms", "r.needs_text").distinct()


@query(f"""WITH q AS (SELECT DISTINCT s.id, q.index AS n, q.question_text AS question, q.signal_id AS signal_id FROM (SELECT id, unnest(questions) AS q FROM interview_sessions WHERE questions IS NOT NULL) s),
           sig AS (SELECT id, max(redacted_text) AS text, max(topic_tags) AS tags FROM capture_signals WHERE id IS NOT NULL GROUP BY 1),
           x AS (SELECT q.*, sig.text, coalesce(sig.tags, []) AS tags FROM q LEFT JOIN sig ON sig.id = q.signal_id),
           f AS (SELECT id, n, CASE WHEN len(list_filter(string_split({sq('question')}, ' '), lambda w: w <> '')) > 20 THEN 'word_count' END AS a, CASE WHEN len(tags) = 0 THEN 'no_specifics' END AS b,
                        CASE WHEN len(tags) > 0 AND len(list_filter(tags, lambda s: s <> '' AND contains(coalesce(lower(text), ''), lower(s)))) = 0 THEN 'hallucinated_specific' END AS c,
                        CASE WHEN contains(lower(question), 'last friday') THEN 'generic_phrase' END AS d FROM x WHERE question IS NOT NULL)
           SELECT id, n, concat_ws(',', a, b, c, d) AS failures FROM f""")
def question_gate(t: Tables) -> DataFrame:
    """All that is wrong with each question, held against the signal it asks about."""
    q = t.interview_sessions.where("questions is not null").select("id", F.explode("questions").alias("q")).select("id", F.col("q.index").alias("n"), F.col("q.question_text").alias("question"), "q.signal_id").distinct()
    s = t.capture_signals.join(q.select(F.col("signal_id").alias("id")).distinct(), "id", "left_semi").groupBy("id").agg(F.max("redacted_text").alias("text"), F.max("topic_tags").alias("tags"))
    x = q.where("question is not null").join(s.withColumnRenamed("id", "signal_id"), "signal_id", "left")
    fails = drafts.question_failures(F.col("question"), F.coalesce("tags", F.array().cast("array<string>")), F.col("text"), 20, ["last friday"])
    return x.select("id", "n", F.array_join(fails, ",").alias("failures"))


CATEGORIES = {"security": ["password", "phishing", "backup"], "books": ["payroll", "invoice", "bank"], "devices": ["laptop", "printer", "print server"]}


@query("""WITH h AS (SELECT doc_id, contains(lower(text), 'password')::INT + contains(lower(text), 'phishing')::INT + contains(lower(text), 'backup')::INT AS a,
                 contains(lower(text), 'payroll')::INT + contains(lower(text), 'invoice')::INT + contains(lower(text), 'bank')::INT AS b,
                 contains(lower(text), 'laptop')::INT + contains(lower(text), 'printer')::INT + contains(lower(text), 'print server')::INT AS c FROM documents WHERE text IS NOT NULL)
          SELECT doc_id, CASE WHEN a = 0 AND b = 0 AND c = 0 THEN NULL WHEN a >= b AND a >= c THEN 'security' WHEN b >= c THEN 'books' ELSE 'devices' END AS category FROM h""")
def document_categories(t: Tables) -> DataFrame:
    return t.documents.where("text is not null").select("doc_id", drafts.category(F.col("text"), CATEGORIES).alias("category"))


@query("""SELECT DISTINCT id, '{"focusKeyword":' || to_json(primary_keyword) || ',"location":"' || CASE WHEN trim(coalesce(pillar, '')) = '' THEN 'Canada' ELSE trim(pillar) END || '","language":"en","insightsText":' || to_json(proposed_title)
                 || CASE WHEN low_corpus_confidence THEN ',"correctionInstructions":"more sources"' ELSE '' END || '}' AS brief FROM article_candidates WHERE primary_keyword IS NOT NULL AND proposed_title IS NOT NULL""")
def briefs(t: Tables) -> DataFrame:
    """Briefs as JSON with defaults for blank values and without keys that are not set."""
    c = t.article_candidates.where("primary_keyword is not null and proposed_title is not null")
    correction = F.when(F.col("low_corpus_confidence"), " more sources ").otherwise(" ")
    return c.select("id", drafts.brief(F.col("primary_keyword"), F.col("proposed_title"), F.col("pillar"), F.lit(" "), correction, "Canada", "en").alias("brief")).distinct()


# --- transcripts as texts, summaries of runs -------------------------------------------------


@query(f"""WITH l AS (SELECT session_id, CAST(ts AS DATE) AS day, ts, path, uuid, CASE {KIND} WHEN 'user_text' THEN 'USER: ' || text WHEN 'assistant_text' THEN 'ASSISTANT: ' || text WHEN 'tool_call' THEN CASE WHEN summary <> '' THEN 'TOOL[' || tool || ']: ' || summary END END AS line
                      FROM session_events WHERE depth = 0 AND session_id IS NOT NULL AND ts IS NOT NULL AND path IS NOT NULL AND uuid IS NOT NULL)
           SELECT session_id, day, string_agg(line, chr(10) || chr(10) ORDER BY ts, path, uuid, line) AS text FROM l WHERE line IS NOT NULL GROUP BY 1, 2""")
def transcript_days(t: Tables) -> DataFrame:
    """The transcript of each session and day as one text."""
    e = t.session_events.where("depth = 0 and session_id is not null and ts is not null and path is not null and uuid is not null").withColumn("day", F.to_date("ts"))
    return S.composed(e, "session_id", "day")


@query("""WITH e AS (SELECT session_id, ts, path, uuid, kind, text, row_number() OVER (PARTITION BY session_id ORDER BY ts, path, uuid, kind NULLS FIRST, text NULLS FIRST) AS rn FROM session_events WHERE session_id IS NOT NULL AND ts IS NOT NULL AND path IS NOT NULL AND uuid IS NOT NULL),
          f AS (SELECT session_id, ts, path, uuid, coalesce(kind = 'user_text' AND starts_with(text, 'Can you'), false) AS stripped FROM e WHERE rn = 1)
          SELECT e.session_id, any_value(f.stripped) AS stripped, count(*) FILTER (NOT (f.stripped AND e.ts = f.ts AND e.path = f.path AND e.uuid = f.uuid)) AS n FROM e JOIN f USING (session_id) GROUP BY 1""")
def continued_sessions(t: Tables) -> DataFrame:
    """Sessions without the message that only continues an earlier one, and how many events are left."""
    e = t.session_events.where("session_id is not null and ts is not null and path is not null and uuid is not null")
    kept, marked = S.without_scaffold(e, "Can you")
    n = kept.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    return marked.join(n, "session_id", "left").select("session_id", "stripped", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""WITH {_LINES}, out AS (SELECT path, count(*) AS n FROM good WHERE NOT meta AND (NOT is_user OR trim(text, ' ') <> '') GROUP BY 1)
           SELECT path, lines_read AS lines_in, coalesce(n, 0) AS events_out, lines_failed AS failures, CASE WHEN lines_read > 0 THEN printf('%.1f%%', round(100.0 * coalesce(n, 0) / lines_read, 1)) ELSE 'n/a' END AS ratio, coalesce(n, 0) = 0 AS empty FROM files LEFT JOIN out USING (path)""")
def compression_report(t: Tables) -> DataFrame:
    """Lines in, events out, failures and their ratio for each transcript, and which gave no event at all."""
    lines, stats = files.parsed_lines(_raw_lines(t))
    out = S.kept_lines(lines).groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    ratio = F.when(F.col("lines_read") > 0, F.concat(F.format_string("%.1f", F.round(n * 100.0 / F.col("lines_read"), 1)), F.lit("%"))).otherwise("n/a")
    return stats.join(out, "path", "left").select("path", F.col("lines_read").alias("lines_in"), n.alias("events_out"), F.col("lines_failed").alias("failures"), ratio.alias("ratio"), (n == 0).alias("empty"))


@query(f"""WITH f AS (SELECT session_id, unnest([text, summary]) AS field FROM session_events WHERE session_id IS NOT NULL)
           SELECT session_id, count(field) AS fields_scanned, coalesce(sum(len(regexp_extract_all(field, '{EMAIL}'))), 0)::BIGINT AS emails FROM f GROUP BY 1""")
def redaction_scan(t: Tables) -> DataFrame:
    """Text fields scanned in each session, and what was replaced in them."""
    f = t.session_events.where("session_id is not null").select("session_id", F.explode(F.array("text", "summary")).alias("field"))
    return f.groupBy("session_id").agg(F.count("field").alias("fields_scanned"), F.coalesce(F.sum(F.regexp_count("field", F.lit(EMAIL))), F.lit(0)).cast("long").alias("emails"))


@query("""WITH c AS (SELECT DISTINCT id AS candidate_id, 1 AS attempt FROM article_candidates WHERE id IS NOT NULL),
          s AS (SELECT candidate_id, dense_rank() OVER (PARTITION BY candidate_id ORDER BY id) AS attempt, status FROM interview_sessions WHERE candidate_id IS NOT NULL)
          SELECT c.candidate_id, c.attempt FROM c ANTI JOIN (SELECT candidate_id, attempt FROM s WHERE status = 'completed') d ON d.candidate_id = c.candidate_id AND d.attempt = c.attempt""")
def first_attempts_open(t: Tables) -> DataFrame:
    """Candidates without a completed first attempt: an anti-join on candidate and attempt."""
    from pyspark.sql import Window

    c = t.article_candidates.where("id is not null").select(F.col("id").alias("candidate_id"), F.lit(1).alias("attempt")).distinct()
    w = Window.partitionBy("candidate_id").orderBy("id")
    s = t.interview_sessions.where("candidate_id is not null").withColumn("attempt", F.dense_rank().over(w)).where("status = 'completed'")
    return c.join(s.select("candidate_id", "attempt"), ["candidate_id", "attempt"], "left_anti")


@query("""SELECT i.id AS session_id, c.id AS candidate_id, count(*) AS n FROM interview_sessions i JOIN article_candidates c ON c.id = i.candidate_id AND c.status = CASE i.status WHEN 'completed' THEN 'interview_complete' ELSE 'awaiting_interview' END GROUP BY ALL""")
def sessions_in_step(t: Tables) -> DataFrame:
    """Interviews whose candidate is in the state that theirs asks for: a join on candidate and state."""
    i = t.interview_sessions.select(F.col("id").alias("session_id"), "candidate_id", F.when(F.col("status") == "completed", "interview_complete").otherwise("awaiting_interview").alias("status"))
    return i.join(t.article_candidates.select(F.col("id").alias("candidate_id"), "status"), ["candidate_id", "status"]).groupBy("session_id", "candidate_id").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type END AS command FROM events""")
def chat_commands(t: Tables) -> DataFrame:
    """Messages that are commands, apart from plain text."""
    n = F.col("event_id") % 3
    text = F.when(n == 0, F.concat(F.lit("/"), F.upper("event_type"), F.lit("@bot now"))).when(n == 1, F.concat(F.lit(" /"), "event_type")).otherwise(F.col("event_type"))
    return t.events.select("event_id", A.command_of(text).alias("command"))


# --- sinks, folders, dispatches --------------------------------------------------------------


@query(f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY session_id, path ORDER BY uuid, kind) AS rn FROM session_events WHERE {_OK} AND depth = 0)
           SELECT session_id, count(e.session_id) AS n_events FROM (SELECT DISTINCT session_id FROM cowork_sessions WHERE session_id IS NOT NULL) s LEFT JOIN (SELECT session_id FROM e WHERE rn = 1) e USING (session_id) GROUP BY 1""")
def landed_documents(t: Tables) -> DataFrame:
    """Session documents written as JSON lines to the shared folder, read back and judged."""
    import uuid

    from loomstone.storage import own_tables

    e = t.session_events.where(_OK).where("depth = 0").groupBy("session_id", "path").agg(F.min(F.struct("uuid", "kind", "depth", "ts", "text", "tool", "summary", "subagent_slug", "parent_tool_use_id", "cwd", "git_branch")).alias("m")).select("session_id", "path", "m.*")
    e = e.withColumn("summary", F.substring("summary", 1, 80))
    s = t.cowork_sessions.where("session_id is not null").groupBy("session_id").agg(F.max(F.struct("created_at", "session_slug", "workspace_id", "title", "last_activity_at", "model", "account", "mcp_servers")).alias("m")).select("session_id", "m.*")
    docs = files.judged(files.build_documents(s, e, max_depth=0).select(F.col("session_id").alias("path"), "doc"))
    path = f"{own_tables(t.spark)}/documents-{uuid.uuid4().hex}"
    files.write_documents(docs, path)
    back = files.judged(t.spark.read.text(path).select(F.monotonically_increasing_id().alias("path"), F.col("value").alias("doc"))).where("error_kind is null")
    n = F.size(F.from_json(F.get_json_object("doc", "$.events"), "array<string>"))
    return back.select(F.get_json_object("doc", "$.sessionId").alias("session_id"), n.cast("long").alias("n_events"))


@query("""WITH w AS (SELECT DISTINCT source AS display_name FROM mix_targets WHERE source IS NOT NULL), f AS (SELECT source AS display_name, min(doc_id) AS id FROM documents WHERE source IS NOT NULL GROUP BY 1)
          SELECT display_name, CAST(id AS VARCHAR) AS id, id IS NOT NULL AS found FROM w LEFT JOIN f USING (display_name)""")
def folder_ids(t: Tables) -> DataFrame:
    """Wanted folders with their ids, and those that do not exist."""
    wanted = t.mix_targets.where("source is not null").select(F.col("source").alias("display_name"))
    folders = t.documents.where("source is not null").select(F.col("source").alias("display_name"), F.col("doc_id").alias("id"))
    ok, missing = S.resolve_folders(wanted, folders)
    return ok.select("display_name", F.col("id").cast("string").alias("id"), F.lit(True).alias("found")).unionByName(missing.select("display_name", F.lit(None).cast("string").alias("id"), F.lit(False).alias("found")))


@query(f"""WITH {_LINES} SELECT path, uuid, uuid AS tool_use_id, 'Look around' AS prompt FROM good WHERE NOT meta AND NOT is_user AND uuid < '8'""")
def dispatch_prompts(t: Tables) -> DataFrame:
    """The agent calls in raw transcript lines, with what they were asked."""
    lines, _ = files.parsed_lines(_raw_lines(t))
    kept = S.kept_lines(lines)
    named = F.transform("blocks", lambda b: b.withField("name", F.when((b["type"] == "tool_use") & (F.col("uuid") < "8"), "Task").otherwise(b["name"])))
    return S.dispatches(kept.withColumn("blocks", named))
