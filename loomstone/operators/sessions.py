"""Session documents and event rows: parsing, flattening, stitching, checks, audits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions import text as T

DROP_REASONS = ["no_transcripts", "slug_blocked", "scheduled_task", "command_message", "system_path_cwd", "meta_missing", "cwd_always_deny", "cwd_not_allowed", "tiny_session", "cwd_majority_outside_allowlist"]
DROPPED_TYPES = ["queue-operation", "last-prompt", "ai-title", "attachment", "system", "progress"]

BLOCK = "struct<type string, text string, name string, id string, input string>"


def kept_lines(lines: DataFrame) -> DataFrame:
    """Raw transcript lines ``(type, timestamp, uuid, isMeta, blocks, content)`` that become events: of user
    or assistant, not meta, with a time and a uuid, users' lines without any tool result, and with a text."""
    blocks = F.coalesce(F.col("blocks"), F.expr(f"cast(array() as array<{BLOCK}>)"))
    tool_result = F.exists(blocks, lambda b: b["type"] == "tool_result")
    has_text = (F.length(F.trim(F.coalesce("content", F.lit("")))) > 0) | (F.size(blocks) > 0)
    return lines.where(
        F.col("type").isin("user", "assistant")
        & ~F.coalesce(F.col("isMeta"), F.lit(False))
        & F.col("timestamp").isNotNull()
        & F.col("uuid").isNotNull()
        & ~((F.col("type") == "user") & F.coalesce(tool_result, F.lit(False)))
        & has_text
    )


def explode_blocks(lines: DataFrame) -> DataFrame:
    """Assistants' lines as one event per text or tool-use block: the uuid of block n is ``uuid#n`` (of the
    first ``uuid``); blocks of other types count in n and give no event."""
    x = lines.where(F.col("type") == "assistant").select("timestamp", "uuid", F.posexplode("blocks").alias("n", "b"))
    x = x.where(F.col("b.type").isin("text", "tool_use"))
    uuid = F.when(F.col("n") == 0, F.col("uuid")).otherwise(F.concat("uuid", F.lit("#"), F.col("n")))
    return x.where((F.col("b.type") == "tool_use") | (F.length(F.trim("b.text")) > 0)).select(
        "timestamp",
        uuid.alias("uuid"),
        F.when(F.col("b.type") == "text", "assistant_text").otherwise("tool_call").alias("kind"),
        F.when(F.col("b.type") == "text", F.col("b.text")).alias("text"),
        F.col("b.name").alias("tool"),
        F.when(F.col("b.type") == "tool_use", T.tool_summary(F.col("b.name"), F.col("b.input"))).alias("summary"),
        F.col("b.id").alias("tool_use_id"),
    )


def transcript_line(kind: Column, text: Column, tool: Column, summary: Column) -> Column:
    """``USER: ...``, ``ASSISTANT: ...`` or ``TOOL[name]: ...``; null for events that are not shown."""
    return (
        F.when(kind == "user_text", F.concat(F.lit("USER: "), text))
        .when(kind == "assistant_text", F.concat(F.lit("ASSISTANT: "), text))
        .when((kind == "tool_call") & (summary != ""), F.concat(F.lit("TOOL["), tool, F.lit("]: "), summary))
    )


def keep_or_drop(n_transcripts: Column, slug_blocked: Column, first_text: Column, meta_missing: Column, cwd: Column, allow: list[str], deny: list[str]) -> Column:
    """The first reason to drop a session before parsing, null to keep it."""
    t = F.coalesce(first_text, F.lit(""))
    return (
        F.when(n_transcripts == 0, "no_transcripts")
        .when(slug_blocked, "slug_blocked")
        .when(t.startswith("<scheduled-task"), "scheduled_task")
        .when(t.startswith("<command-message"), "command_message")
        .when(t.startswith("<system-path-cwd"), "system_path_cwd")
        .when(meta_missing, "meta_missing")
        .when(T.under_any(cwd, deny), "cwd_always_deny")
        .when((F.coalesce(cwd, F.lit("")) != "") & ~T.under_any(cwd, allow), "cwd_not_allowed")
    )


def post_check(events: DataFrame, allow: list[str], deny: list[str], min_events: int = 3, min_chars: int = 500, min_share: float = 0.8) -> DataFrame:
    """Per session the text of its events by folder and the verdict: ``tiny_session``,
    ``cwd_majority_outside_allowlist`` or null. Denial beats permission; text without a folder is in
    no share; a session without any folder is kept."""
    n = F.length(F.coalesce("text", F.lit("")))
    no_cwd = F.coalesce(F.col("cwd"), F.lit("")) == ""
    denied = ~no_cwd & T.under_any(F.col("cwd"), deny)
    allowed = ~no_cwd & ~denied & T.under_any(F.col("cwd"), allow)
    s = events.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.sum(n).alias("chars"),
        F.sum(F.when(allowed, n).otherwise(0)).alias("chars_allowed"),
        F.sum(F.when(no_cwd, n).otherwise(0)).alias("chars_no_cwd"),
    )
    base = F.col("chars") - F.col("chars_no_cwd")
    share = F.when(base > 0, F.col("chars_allowed") / base)
    verdict = F.when((F.col("n_events") < min_events) | (F.col("chars") < min_chars), "tiny_session").when(share < min_share, "cwd_majority_outside_allowlist")
    return s.select("session_id", "n_events", "chars", "chars_allowed", "chars_no_cwd", F.round(share, 6).alias("allowed_share"), verdict.alias("drop_reason"))


def drop_summary(verdicts: DataFrame, column: str = "drop_reason", reasons: list[str] = DROP_REASONS) -> DataFrame:
    """Counts of every reason, those that never occur with 0, and of ``kept``."""
    dim = verdicts.sparkSession.createDataFrame([(r,) for r in ["kept", *reasons]], "reason string")
    got = verdicts.groupBy(F.coalesce(column, F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("c"))
    return dim.join(got, "reason", "left").select("reason", F.coalesce("c", F.lit(0)).alias("n"))


def parents_of(events: DataFrame) -> DataFrame:
    """``(session_id, uuid, parent_uuid)``: each nested event with the subagent event it lies in. The
    parent's path is the event's without its last step, so this is an equi-join on both."""
    parent_path = F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0)))
    child = events.where((F.col("depth") > 0) & F.col("uuid").isNotNull()).select("session_id", parent_path.alias("p"), "uuid")
    kind = F.regexp_replace(F.lower(F.trim("kind")), r"[-\s]", "_")
    parent = events.where((kind == "subagent") & F.col("uuid").isNotNull()).select("session_id", F.col("path").alias("p"), F.col("uuid").alias("parent_uuid"))
    return child.join(parent, ["session_id", "p"]).select("session_id", "uuid", "parent_uuid").distinct()


def stitch(dispatches: DataFrame, subagents: DataFrame, chars: int = 80) -> DataFrame:
    """``(session_id, tool_use_id, subagent_id)``: dispatch calls ``(session_id, ord, tool_use_id, prompt)``
    matched to subagents ``(session_id, ord, subagent_id, first_text)``, one to one and greedily in order:
    the first free subagent with which the prompt begins (its first ``chars`` characters). Empty ones never
    match; subagents without a dispatch have a null tool_use_id.

    Matching is sequential within a session and made on its dispatches and subagents only, few rows of
    bounded text.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf.call].sort_values(["ord", "id"]), pdf[~pdf.call].sort_values(["ord", "id"])
        free = [(i, (t or "")[:chars]) for i, t in zip(b.id, b.t)]
        rows = []
        for tid, prompt in zip(a.id, a.t):
            hit = next((f for f in free if f[1] and (prompt or "").startswith(f[1])), None)
            if hit:
                free.remove(hit)
                rows.append((pdf.session_id.iloc[0], tid, hit[0]))
        rows += [(pdf.session_id.iloc[0], None, i) for i, _ in free]
        return pd.DataFrame(rows, columns=["session_id", "tool_use_id", "subagent_id"])

    d = dispatches.select("session_id", "ord", F.col("tool_use_id").alias("id"), F.substring("prompt", 1, chars).alias("t"), F.lit(True).alias("call"))
    s = subagents.select("session_id", "ord", F.col("subagent_id").alias("id"), F.substring("first_text", 1, chars).alias("t"), F.lit(False).alias("call"))
    return d.unionByName(s).groupBy("session_id").applyInPandas(run, "session_id string, tool_use_id string, subagent_id string")


def chain_groups(first_texts: DataFrame) -> DataFrame:
    """Transcripts ``(session_id, slug, ord, first_text, stripped)`` of one session share the group id of
    their original, the first that is not stripped of a continuation's scaffold; sessions of one
    transcript, or without slug or text, have none."""
    w = Window.partitionBy("session_id")
    original = F.min(F.when(~F.col("stripped"), F.struct("ord", "slug", "first_text"))).over(w)
    group = T.continuation_group(original["slug"], original["first_text"])
    return first_texts.withColumn("continuation_group_id", F.when(F.count(F.lit(1)).over(w) >= 2, group))


def dispatches(lines: DataFrame) -> DataFrame:
    """``(path, uuid, tool_use_id, prompt)`` of the agent calls in raw transcript lines."""
    x = lines.select("path", "uuid", F.explode("blocks").alias("b")).where((F.col("b.type") == "tool_use") & F.col("b.name").isin("Agent", "Task") & F.col("b.id").isNotNull())
    return x.select("path", "uuid", F.col("b.id").alias("tool_use_id"), F.get_json_object("b.input", "$.prompt").alias("prompt")).where("prompt <> ''")


def resolve_folders(wanted: DataFrame, folders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids ``(display_name, id)`` of the wanted mail folders, and the wanted names that do not exist."""
    w = wanted.select("display_name").distinct()
    f = folders.groupBy("display_name").agg(F.min("id").alias("id"))
    return w.join(f, "display_name"), w.join(f, "display_name", "left_anti")


def export(sessions: DataFrame, events: DataFrame, allow: list[str], deny: list[str], redact) -> tuple[DataFrame, DataFrame]:
    """Events of the sessions that pass all checks, their texts through ``redact`` (a column function) and
    summaries cut to 80 again, and the audit of every session.

    ``sessions (session_id, n_transcripts, slug_blocked, first_text, meta_missing, cwd)``. The audit has
    ``(session_id, drop_reason)``, null for kept ones.
    """
    before = sessions.select("session_id", keep_or_drop(F.col("n_transcripts"), F.col("slug_blocked"), F.col("first_text"), F.col("meta_missing"), F.col("cwd"), allow, deny).alias("early"))
    text_events = events.where((F.col("depth") == 0) & F.col("kind").isin("user_text", "assistant_text"))
    after = post_check(text_events, allow, deny).select("session_id", F.col("drop_reason").alias("late"))
    # A session without any text event has no row in ``after`` and is as tiny as can be.
    after = after.withColumn("judged", F.lit(True))
    late = F.when(F.col("judged").isNull(), F.lit("tiny_session")).otherwise(F.col("late"))
    audit = before.join(after, "session_id", "left").select("session_id", F.coalesce("early", late).alias("drop_reason"))
    kept = events.join(audit.where("drop_reason is null").select("session_id"), "session_id", "left_semi")
    red = kept.withColumn("text", redact(F.col("text"))).withColumn("summary", F.substring(redact(F.col("summary")), 1, 80))
    return red, audit


# Fixed value: how the first message of a continued session begins.
SCAFFOLD = "This session is being continued from a previous conversation that ran out of context."


def without_scaffold(events: DataFrame, prefix: str = SCAFFOLD) -> tuple[DataFrame, DataFrame]:
    """``events`` without the first event of each session where that is a user's text that begins with ``prefix``, and
    ``(session_id, stripped)``. The first event is the smallest by ts, path and uuid."""
    at = F.struct("ts", "path", "uuid")
    first = events.groupBy("session_id").agg(F.min(F.struct("ts", "path", "uuid", "kind", "text")).alias("m"))
    hit = F.coalesce((F.col("m.kind") == "user_text") & F.startswith(F.col("m.text"), F.lit(prefix)), F.lit(False))
    marked = first.select("session_id", hit.alias("stripped"), F.struct("m.ts", "m.path", "m.uuid").alias("first"))
    gone = marked.where("stripped").select("session_id", "first")
    kept = events.join(gone, (events["session_id"] == gone["session_id"]) & at.eqNullSafe(F.col("first")), "left_anti")
    return kept, marked.select("session_id", "stripped")


def composed(events: DataFrame, *by: str) -> DataFrame:
    """``(*by, text)``: what was said and done, line by line in order of ts, path and uuid with an empty line between.

    One value for each group: by session as a reader wants it, by session and day where sessions have no bound.
    """
    kind = F.regexp_replace(F.lower(F.trim("kind")), r"[-\s]", "_")
    lines = events.select(*by, F.struct("ts", "path", "uuid", transcript_line(kind, F.col("text"), F.col("tool"), F.col("summary")).alias("line")).alias("l")).where("l.line is not null")
    return lines.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n\n").alias("text"))
