"""Table upkeep as plans: appends that insert only what is new, upserts, guarded updates, soft deletes.

Parquet has no MERGE: each operator gives the new snapshot or the rows to append, and the caller
writes it. None of them needs a RETURNING, as ids are hashes of the natural key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UUID = r"^(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def latest_rows(df: DataFrame, key: str, order: list[str], keep: list[str]) -> DataFrame:
    """One row per non-null key: the one greatest by ``order``, nulls lowest, then by ``keep``.

    A maximum over a struct, so every task first keeps one row per key: a key that holds a third of
    the table costs nothing extra. Columns outside ``order`` and ``keep`` are not read.
    """
    cols = list(dict.fromkeys([*order, *keep]))
    best = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*cols)).alias("_best"))
    return best.select(key, *[F.col(f"_best.{c}").alias(c) for c in keep])


def insert_if_absent(batch: DataFrame, existing: DataFrame, key: str, order: list[str], keep: list[str]) -> DataFrame:
    """The rows of ``batch`` to append: of each key that ``existing`` lacks one row, the smallest by
    ``order``. Rows without a key are not appended."""
    cols = list(dict.fromkeys([*order, *keep]))
    first = batch.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*cols)).alias("_first"))
    new = first.join(existing.select(key), key, "left_anti")
    return new.select(key, *[F.col(f"_first.{c}").alias(c) for c in keep])


def upsert_max(existing: DataFrame, changes: DataFrame, key: str, value: str) -> DataFrame:
    """A checkpoint table after ``changes``: per key the greatest value of both, null values ignored."""
    both = existing.select(key, value).unionByName(changes.select(key, value))
    return both.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(value).alias(value))


def since(df: DataFrame, ts: str, checkpoint: Column) -> DataFrame:
    """Rows from the checkpoint on, the boundary included; what is read twice goes by its key."""
    return df.where(F.col(ts) >= checkpoint)


def guarded_update(df: DataFrame, column: str, guard: Column, value: Column) -> DataFrame:
    """The snapshot in which ``column`` has a new value where ``guard`` is true; null guards do not update."""
    return df.withColumn(column, F.when(F.coalesce(guard, F.lit(False)), value).otherwise(F.col(column)))


def soft_delete(requests: DataFrame, id_col: str, current: DataFrame, key: str, deleted: str) -> DataFrame:
    """``(id_col, outcome)`` of each distinct request: invalid, not_found, already_deleted or ok."""
    r = requests.select(id_col).distinct()
    c = current.select(F.col(key).alias("_key"), F.coalesce(F.col(deleted), F.lit(False)).alias("_deleted"))
    j = r.join(c, F.col(id_col) == F.col("_key"), "left")
    outcome = (
        F.when(~F.coalesce(F.col(id_col).rlike(UUID), F.lit(False)), "invalid")
        .when(F.col("_key").isNull(), "not_found")
        .when(F.col("_deleted"), "already_deleted")
        .otherwise("ok")
    )
    return j.select(id_col, outcome.alias("outcome"))


def apply_soft_deletes(df: DataFrame, key: str, deleted: str, outcomes: DataFrame, id_col: str) -> DataFrame:
    """The snapshot after the requests that are ok."""
    ok = outcomes.where("outcome = 'ok'").select(F.col(id_col).alias("_gone"))
    j = df.join(ok, F.col(key) == F.col("_gone"), "left")
    return j.withColumn(deleted, F.col("_gone").isNotNull() | F.coalesce(F.col(deleted), F.lit(False))).drop("_gone")


def array_append(df: DataFrame, column: str, entry: Column) -> DataFrame:
    """``entry`` behind the array's last element; a null array counts as empty."""
    return df.withColumn(column, F.concat(F.coalesce(F.col(column), F.array()), F.array(entry)))


def with_discards(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """The rows to keep and those to discard, both with ``reason``, which is null for kept ones: the audit of
    what was left out."""
    x = df.withColumn("reason", reason)
    return x.where(F.col("reason").isNull()), x.where(F.col("reason").isNotNull())


def touched(df: DataFrame, changed: Column, now: Column, column: str = "updated_at") -> DataFrame:
    """``column`` set to ``now`` in rows that an update has changed; the others keep theirs."""
    return df.withColumn(column, F.when(F.coalesce(changed, F.lit(False)), now).otherwise(F.col(column)))
