"""Streams of chat events: waiting for replies with a time-out, de-duplication, windows.

The transitions are one pure function. A stream applies it with state per key; a replay of a log
applies it to each key's events in order, so both give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomstone.session import ship

DAY_MS = 86_400_000
WAIT_DAYS = 7

EVENT = "key string, ts timestamp, name string, ref string, text string"
OUTCOME = "key string, ref string, outcome string, at timestamp, text string"
STATE = "ref string, asked_ms long"

Pending = tuple[str, int] | None


def step(pending: Pending, ms: int, name: str, ref: str, text: str | None, wait_ms: int = WAIT_DAYS * DAY_MS) -> tuple[Pending, list[tuple[str, str, int, str | None]]]:
    """One event against what is waited for: the new state and outcomes ``(ref, outcome, ms, text)``.

    ``asked`` waits for a reply, ``reply`` within the time answers, ``skip`` ends the wait, any event
    after the time first gives a ``timeout``. A new question replaces one that waits.
    """
    out: list[tuple[str, str, int, str | None]] = []
    if pending and ms > pending[1] + wait_ms:
        out.append((pending[0], "timeout", pending[1] + wait_ms, None))
        pending = None
    if name == "asked":
        if pending:
            out.append((pending[0], "superseded", ms, None))
        pending = (ref, ms)
    elif pending and name == "reply":
        out.append((pending[0], "replied", ms, text))
        pending = None
    elif pending and name == "skip":
        out.append((pending[0], "skipped", ms, None))
        pending = None
    return pending, out


def _ms(ts: pd.Timestamp) -> int:
    return int(ts.value // 1_000_000)


def _frame(key: str, out: list[tuple[str, str, int, str | None]]) -> pd.DataFrame:
    def column(values: list) -> pd.Series:
        return pd.Series(values, dtype=object)

    at = pd.Series(pd.to_datetime([o[2] for o in out], unit="ms"), dtype="datetime64[ns]")
    return pd.DataFrame({"key": column([key] * len(out)), "ref": column([o[0] for o in out]), "outcome": column([o[1] for o in out]), "at": at, "text": column([o[3] for o in out])})


def replay(events: DataFrame, wait_ms: int = WAIT_DAYS * DAY_MS) -> DataFrame:
    """Outcomes of a log of ``EVENT`` rows; waits that a log leaves open have none.

    The same as ``step`` over each key's events in order of time, name and ref, as a plan: what becomes of a
    question is decided by the next question, reply or skip. Events are laid on lines of one key and two
    waiting times, so a chat of any size is cut by time. Events without key or time are left out.
    """
    e = events.where("key is not null and ts is not null").withColumn("ms", F.unix_millis("ts"))
    span = F.floor(F.col("ms") / wait_ms)
    turns = e.where(F.col("name").isin("asked", "reply", "skip"))
    line = turns.withColumn("own", span).withColumn("span", F.explode(F.array(span, span - 1)))
    w = Window.partitionBy("key", "span").orderBy("ts", "name", "ref")
    after = F.lead(F.struct("ms", "name", "text")).over(w)
    asked = line.withColumn("next", after).where("own = span and name = 'asked'").select("key", "ref", "ms", "next")
    until = F.col("ms") + wait_ms
    last = e.groupBy("key").agg(F.max("ms").alias("last"))
    x = asked.join(last, "key").withColumn("met", F.coalesce(F.col("next.ms") <= until, F.lit(False)))
    outcome = (
        F.when(F.col("met") & (F.col("next.name") == "asked"), "superseded")
        .when(F.col("met") & (F.col("next.name") == "reply"), "replied")
        .when(F.col("met"), "skipped")
        .when(F.col("last") > until, "timeout")
    )
    at = F.timestamp_millis(F.when(F.col("met"), F.col("next.ms")).otherwise(until))
    text = F.when(F.col("met") & (F.col("next.name") == "reply"), F.col("next.text"))
    return x.select("key", "ref", outcome.alias("outcome"), at.alias("at"), text.alias("text")).where("outcome is not null")


def watch(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Outcomes of a stream of ``EVENT`` rows, with event-time time-outs once the watermark passes them."""
    ship(events.sparkSession)

    def run(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending: Pending = (state.get[0], state.get[1]) if state.exists else None
        out: list = []
        if state.hasTimedOut:
            if pending:
                out.append((pending[0], "timeout", pending[1] + WAIT_DAYS * DAY_MS, None))
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values(["ts", "name", "ref"])
            for r in rows.itertuples():
                pending, got = step(pending, _ms(r.ts), r.name, r.ref, r.text)
                out += got
            if pending:
                state.update(pending)
                state.setTimeoutTimestamp(max(pending[1] + WAIT_DAYS * DAY_MS + 1, state.getCurrentWatermarkMs() + 1))
            elif state.exists:
                state.remove()
        yield _frame(key[0], out)

    x = events.where("key is not null and ts is not null").withWatermark("ts", late)
    return x.groupBy("key").applyInPandasWithState(run, OUTCOME, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def without_repeats(events: DataFrame, key: str, ts: str, late: str = "1 day") -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def counts_per_window(events: DataFrame, ts: str, by: str, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """``(window_start, by, n)`` of tumbling windows."""
    g = events.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("window_start"), by, "n")


def activity_sessions(events: DataFrame, ts: str, by: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """``(by, started_at, ended_at, n)`` of runs of events without a longer gap."""
    g = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return g.select(by, F.col("w.start").alias("started_at"), F.col("w.end").alias("ended_at"), "n")
