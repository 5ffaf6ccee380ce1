"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.session import ship
from loomstone.storage import Table, cut

__all__ = ["Table", "by_bytes", "cut", "kind_key", "one_text_per_id", "table", "tokenizer_dir"]

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kind_key(c):
    """A spelling-proof form of a label: case, outer blanks, ``-`` and blank for ``_``."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[-\s]", "_")


def one_text_per_id(signals: DataFrame, *more: str) -> DataFrame:
    """One row ``(id, redacted_text, *more)`` per signal; rows without an id are left out.

    All rows of one id hold one text, so any row's text serves: the rows are brought together by
    ``max`` over a struct, of which each task first keeps one per id.
    """
    cols = ["redacted_text", *more]
    best = F.max(F.struct(F.col("ingested_at"), *cols)).alias("_m")
    return signals.where(F.col("id").isNotNull()).groupBy("id").agg(best).select("id", *[F.col(f"_m.{c}").alias(c) for c in cols])


def by_bytes(batch: pa.RecordBatch, column: int, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most about ``most`` bytes of texts, one row at least, so that long texts do not add up in memory."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    lo, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > lo and held + n > most:
            yield batch.slice(lo, i - lo)
            lo, held = i, 0
        held += n
    if batch.num_rows:
        yield batch.slice(lo)


def tokenizer_dir() -> str:
    return os.environ.get("LOOMSTONE_TOKENIZERS", "/opt/tokenizers")
