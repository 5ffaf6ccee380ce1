"""Ingestion of sessions and messages end to end: judge, redact, chunk, embed, append what is new."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.functions import dates as D
from loomstone.functions import text as X
from loomstone.operators import chunking, redaction
from loomstone.operators import tables as T


def message_status(df: DataFrame) -> DataFrame:
    """``captured_at, text, status`` beside a mailbox's columns: drafts and empty bodies are skipped, messages
    without id or a readable time have failed, the rest is ready."""
    at = F.coalesce(F.try_to_timestamp("sent_at"), F.try_to_timestamp("received_at"))
    body = F.when(F.lower("body_type") == "html", X.strip_html(F.col("body"))).otherwise(F.trim("body"))
    status = (
        F.when(F.coalesce("is_draft", F.lit(False)), "skipped_draft")
        .when(F.coalesce("id", F.lit("")) == "", "failed")
        .when(F.coalesce(body, F.lit("")) == "", "skipped_empty")
        .when(at.isNull(), "failed")
        .otherwise("ready")
    )
    return df.withColumn("captured_at", at).withColumn("text", body).withColumn("status", status)


def messages(df: DataFrame, existing: DataFrame, hashes: list[str], subject_pattern: str, keywords: list[str]) -> tuple[DataFrame, DataFrame]:
    """Signals to append, and ``(status, n)`` of the run. ``existing``: a table with ``source_id``."""
    ready = message_status(df)
    ok = ready.where("status = 'ready'").drop("status")
    reason = redaction.block_reason(F.col("sender"), F.col("recipients"), F.col("subject"), F.col("text"), hashes, subject_pattern, keywords)
    red = redaction.redact(ok, "text", reason)
    flowing = red.where("status = 'redacted'")
    rows = signals(flowing.select("id", "captured_at", "redacted_text", "redaction_log"), "msgraph-email")
    new = T.insert_if_absent(rows, existing, "source_id", ["captured_at"], [c for c in rows.columns if c != "source_id"])
    counts = ready.where("status <> 'ready'").select("status").unionByName(red.select(F.when(F.col("status") == "blocked", "blocked").otherwise("flowing").alias("status")))
    return new, counts.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def signals(df: DataFrame, source: str) -> DataFrame:
    """``df (id, captured_at, redacted_text, redaction_log)`` as signal rows, one per chunk, with vectors."""
    keyed = df.withColumn("k", F.struct("id", "captured_at", "redaction_log"))
    c = chunking.chunks(keyed, "k", "redacted_text")
    key = X.chunk_source_id(F.lit(source), F.col("k.id"), F.col("chunk_index"))
    return c.select(
        F.sha2(key, 256).alias("id"),
        F.lit(source).alias("source"),
        key.alias("source_id"),
        F.col("k.captured_at").alias("captured_at"),
        F.col("text").alias("redacted_text"),
        "token_count",
        F.col("k.redaction_log").alias("redaction_log"),
        chunking.embed(F.col("text")).alias("embedding"),
    )


def run_checkpoint(stored: DataFrame, existing: DataFrame) -> DataFrame:
    """Checkpoints ``(source, last_ingested_at)`` after a run that read all there was: the greatest time of what was
    stored. A mailbox run that may have stopped at its bound keeps one per folder instead (``folder_checkpoints``)."""
    got = stored.groupBy("source").agg(F.max("captured_at").alias("last_ingested_at"))
    return T.upsert_max(existing, got, "source", "last_ingested_at")


def due(df: DataFrame, since: str, hours: int, now) -> DataFrame:
    """Rows whose wait is over: ``hours`` after ``since``."""
    return df.where(D.age_days(now, F.col(since)) * 24 >= hours)
