"""Blocklists and the redaction of messages, closed on failure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.functions.pii import regex_pass
from loomstone.functions.text import sha256_of_address


def block_reason(sender: Column, recipients: Column, subject: Column, body: Column, hashes: list[str], subject_pattern: str, keywords: list[str]) -> Column:
    """Why a message is blocked, null if it is not: ``sender``, ``recipient``, ``subject`` or ``keyword``, the
    first that holds. Addresses are compared by the hash of their small, trimmed form."""
    bad = F.array(*[F.lit(h) for h in hashes]) if hashes else F.array().cast("array<string>")
    known = F.filter(F.coalesce(recipients, F.array().cast("array<string>")), lambda r: r.isNotNull())
    low = F.lower(body)
    hit = F.lit(False)
    for k in keywords:
        hit = hit | low.contains(k.lower())
    return (
        F.when(F.array_contains(bad, sha256_of_address(sender)), "sender")
        .when(F.arrays_overlap(F.transform(known, sha256_of_address), bad), "recipient")
        .when(subject.rlike(f"(?i){subject_pattern}") if subject_pattern else F.lit(False), "subject")
        .when(hit, "keyword")
    )


def blocked_slug(slug: Column, slugs: list[str]) -> Column:
    """The hash of a blocked slug, null for others; exact case, empty ones never match."""
    names = [s for s in slugs if s]
    return F.when(slug.isin(names), F.sha2(slug, 256)) if names else F.lit(None).cast("string")


def redact(df: DataFrame, body: str, reason: Column) -> DataFrame:
    """``status, block_reason, redacted_text, redaction_log`` beside the columns of ``df``: blocked rows have
    an empty text and log, and so has a row on which the pattern pass fails."""
    r = regex_pass(F.col(body))
    x = df.withColumn("_reason", reason).withColumn("_r", r)
    blocked = F.col("_reason").isNotNull() | (F.col("_r.status") == "blocked")
    return x.select(
        *[F.col(c) for c in df.columns],
        F.when(blocked, "blocked").otherwise("redacted").alias("status"),
        F.when(F.col("_reason").isNotNull(), F.col("_reason")).when(blocked, "redaction_failed").alias("block_reason"),
        F.when(blocked, "").otherwise(F.col("_r.text")).alias("redacted_text"),
        F.when(blocked, F.expr("array()").cast("array<struct<type string, offset int, replacement string>>")).otherwise(F.col("_r.log")).alias("redaction_log"),
    )
