"""Rebuilding conversations from message rows.

A conversation is a reply graph: who answers which message. Kahn's algorithm orders it, the smallest time and path
first among the messages that are free; messages left over lie on or behind a cycle and make their conversation a
broken one. Where replies name their message (``edges``), the graph is theirs; where they do not, a message answers
one of the moment before it, and messages of one moment are free together.

Conversations of any size are spread over tasks. Without named replies the order is made in segments: rows are
range-partitioned by (session, ts, path), each task runs Kahn's algorithm on the part of each session it holds and reports
for each the few facts (rows, first and last role, breaks) from which session-wide numbers and verdicts follow.
With named replies a message later than its answer is an exception (a clock that was wrong): where every message is later than
what it answers, Kahn's order with times as ties is the order of times. So only the stretches of time
between an answer and its later message are sorted topologically, each for itself, and keep their place among the rest.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.llm.common import cut, kind_key

USER, ASSISTANT = "user_text", "assistant_text"


def kahn(keys: list, replies_to: list[list[int]]) -> tuple[list[int], list[int]]:
    """Topological order of nodes ``0..n-1`` and the nodes left over, which lie on or behind a cycle.

    ``replies_to[i]`` are the nodes that i answers. Of the nodes that are free the one with the smallest key comes
    first; keys that are equal go by number.
    """
    n = len(keys)
    children: dict[int, list[int]] = {}
    waits = [len(p) for p in replies_to]
    free = []
    for i, parents in enumerate(replies_to):
        if not parents:
            free.append((keys[i], i))
        for p in parents:
            children.setdefault(p, []).append(i)
    heapq.heapify(free)
    order: list[int] = []
    while free:
        _, i = heapq.heappop(free)
        order.append(i)
        for c in children.get(i, ()):
            waits[c] -= 1
            if not waits[c]:
                heapq.heappush(free, (keys[c], c))
    left = sorted(set(range(n)) - set(order)) if len(order) < n else []
    return order, left


def messages(events: DataFrame) -> DataFrame:
    """``(session_id, ts, path, uuid, role)`` of the messages: rows of depth 0, of kind user or
    assistant text in any spelling, with a text that is not blank. Rows of no session are left out."""
    kind = kind_key(F.col("kind"))
    return events.where(
        F.col("session_id").isNotNull() & (F.col("depth") == 0) & kind.isin(USER, ASSISTANT) & F.col("text").rlike(r"[^ \t\r\n]")
    ).select("session_id", "ts", "path", "uuid", F.when(kind == USER, F.lit(1)).otherwise(F.lit(0)).cast("tinyint").alias("role"))


def _key(*names: str):
    return F.struct(*[F.col(n) for n in names])


def reply_order(msgs: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The places of messages by Kahn's algorithm, and the sessions that have none.

    ``msgs (session_id, uuid, ts, path, role)``, one row a message, ``edges (session_id, uuid, parent_uuid)``, of
    which rows with a null count for nothing and repeated ones once. Gives ``msgs`` with ``at``, a struct by which a
    session's messages are in order, and ``(session_id, fault)``: ``cycle`` where messages answer each other in a
    circle or themselves, ``orphan`` where the message that is answered is not there. Edges of messages that are
    not there themselves are left out. An empty table gives empty ones.
    """
    e = edges.select("session_id", "uuid", "parent_uuid").dropna().distinct()
    mine = msgs.select("session_id", "uuid", _key("ts", "path", "uuid").alias("key"))
    e = e.join(mine, ["session_id", "uuid"])
    theirs = mine.select("session_id", F.col("uuid").alias("parent_uuid"), F.col("key").alias("parent_key"))
    e = cut(e.join(theirs, ["session_id", "parent_uuid"], "left"), "replies").df
    orphans = e.where("parent_key is null").select("session_id", F.lit("orphan").alias("fault"))
    # Stretches of time from an answer to a later message it answers; those that overlap are one.
    back = e.where("parent_key >= key").select("session_id", F.col("key").alias("lo"), F.col("parent_key").alias("hi"))
    w = Window.partitionBy("session_id").orderBy("lo", "hi")
    before = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    back = back.withColumn("new", F.when(before.isNull() | (before < F.col("lo")), F.col("lo")))
    back = back.withColumn("region", F.last("new", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    regions = cut(back.groupBy("session_id", "region").agg(F.max("hi").alias("hi")), "stretches").df
    day = lambda c: F.coalesce(F.unix_date(F.to_date(c)), F.lit(0))
    by_day = regions.withColumn("day", F.explode(F.sequence(day("region.ts"), day("hi.ts"))))
    placed = mine.withColumn("day", day("key.ts")).join(by_day, ["session_id", "day"]).where("key >= region and key <= hi").select("session_id", "uuid", "key", "region")
    inner = e.join(regions, "session_id").where("key >= region and key <= hi and parent_key >= region and parent_key <= hi").groupBy("session_id", "uuid").agg(F.collect_set("parent_uuid").alias("parents"))
    rows = placed.join(inner, ["session_id", "uuid"], "left").select("session_id", "uuid", "key", "region", F.coalesce("parents", F.array().cast("array<string>")).alias("parents"))

    def settle(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n", "ascending")])  # by key
        at = {u: i for i, u in enumerate(table["uuid"].to_pylist())}
        order, _ = kahn(list(range(len(at))), [[at[p] for p in ps] for ps in table["parents"].to_pylist()])
        pos: list[int | None] = [None] * len(at)
        for n, i in enumerate(order):
            pos[i] = n
        return pa.table({"session_id": table["session_id"], "uuid": table["uuid"], "pos": pa.array(pos, pa.int32())})

    numbered = rows.withColumn("n", F.row_number().over(Window.partitionBy("session_id", "region").orderBy("key")))
    sorted_ = cut(numbered.select("session_id", "region", "uuid", "parents", "n").groupBy("session_id", "region").applyInArrow(settle, "session_id string, uuid string, pos int").join(placed.select("session_id", "uuid", "region"), ["session_id", "uuid"]), "sorted").df
    cycles = sorted_.where("pos is null").select("session_id", F.lit("cycle").alias("fault"))
    out = msgs.join(sorted_, ["session_id", "uuid"], "left")
    at = F.struct(F.coalesce("region", _key("ts", "path", "uuid")).alias("key"), F.coalesce("pos", F.lit(0)).alias("pos"))
    return out.select("session_id", "uuid", "ts", "path", "role", at.alias("at")), orphans.unionByName(cycles).distinct()


def rebuild(events: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """``(session_id, turn_no, uuid, role, ts)`` of every message of every kept session.

    A session is dropped if one of its messages lacks ``ts`` or ``uuid`` (null or empty), if it has
    no message, if the first message is not the user's, or if a user's message is not directly
    followed by one of the assistant; with ``edges`` (see ``reply_order``) also if they form a cycle or
    answer a message that is not there. Rows of equal uuid in a session are one message: the first by
    ts, then path. Equal (ts, path) of different messages are ordered by uuid. A null path comes
    first. An empty table gives an empty table; columns beyond those named are not read.
    """
    msgs = messages(events)
    lacking = F.col("ts").isNull() | F.col("uuid").isNull() | (F.col("uuid") == "")
    # Tasks first bring the rows of a message together, then rows move once, without their texts.
    one = (
        msgs.groupBy("session_id", F.when(~lacking, F.col("uuid")).alias("uuid"))
        .agg(F.min(F.struct("ts", "path", "role")).alias("m"))
        .select("session_id", "uuid", "m.ts", "m.path", "m.role")
    )
    faults = None
    if edges is None:
        ordered = one.repartitionByRange(F.col("session_id"), F.col("ts"), F.col("path"), F.col("uuid")).sortWithinPartitions("session_id")
        ordered = ordered.select("session_id", "ts", "uuid", "role", "path", F.lit(0).alias("pos"))
    else:
        placed, faults = reply_order(one, edges)
        ordered = placed.repartitionByRange(F.col("session_id"), F.col("at")).sortWithinPartitions("session_id")
        ordered = ordered.select("session_id", F.col("at.key.ts").alias("ts"), F.col("uuid"), "role", F.col("at.key.path").alias("path"), F.col("at.pos").alias("pos"), F.col("at.key.uuid").alias("anchor"), F.col("ts").alias("own_ts"))
    schema = "part int, session_id string, ts timestamp, uuid string, role tinyint, local_no int, bad boolean"

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            # Sessions come one after the other: all but the last of a batch are complete.
            sess = b.column(0)
            last = pc.index(sess, sess[b.num_rows - 1]).as_py()
            if last or held and held[0].column(0)[0] != sess[0]:
                if held and held[0].column(0)[0] != sess[0]:
                    yield from _ordered(pa.Table.from_batches(held), pid)
                    held = []
                if last:
                    yield from _ordered(pa.Table.from_batches([*held, b.slice(0, last)]), pid)
                    held = []
            held.append(b.slice(last))
        if held:
            yield from _ordered(pa.Table.from_batches(held), pid)

    rows = cut(ordered.mapInArrow(segments, schema), "turns").df
    facts = (
        rows.groupBy("session_id", "part")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.bool_or("bad").alias("bad"),
            F.min(F.struct("local_no", "role")).getField("role").alias("first_role"),
            F.max(F.struct("local_no", "role")).getField("role").alias("last_role"),
        )
    )
    # One row per segment from here: as many for a session as partitions hold it.
    w = Window.partitionBy("session_id").orderBy("part")
    whole = Window.partitionBy("session_id")
    facts = facts.select(
        "session_id",
        "part",
        (F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("before"),
        (
            F.col("bad")
            | (F.coalesce(F.lag("last_role").over(w), F.lit(0)) == F.col("first_role")) & (F.col("first_role") == 1)
            | (F.lag("last_role").over(w).isNull() & (F.col("first_role") == 0))
            | (F.lead("first_role").over(w).isNull() & (F.col("last_role") == 1))
        ).alias("bad"),
    )
    facts = facts.withColumn("drop", F.bool_or("bad").over(whole)).where(~F.col("drop")).select("session_id", "part", "before")
    if faults is not None:
        facts = facts.join(faults, "session_id", "left_anti")
    return rows.join(facts, ["session_id", "part"]).select(
        "session_id",
        (F.col("before") + F.col("local_no")).cast("int").alias("turn_no"),
        "uuid",
        F.when(F.col("role") == 1, "user").otherwise("assistant").alias("role"),
        "ts",
    )


def _ordered(t: pa.Table, part: int) -> Iterator[pa.RecordBatch]:
    """Segments of whole or part sessions in the order of Kahn's algorithm, with running numbers and breaks."""
    sess, ts, uuid, role, path, pos = (t.column(i).to_pylist() for i in range(6))
    anchor = t.column(6).to_pylist() if t.num_columns > 6 else uuid
    own_ts = t.column(7) if t.num_columns > 6 else t.column(1)
    lacks = [a is None or b is None for a, b in zip(ts, uuid)]
    # A row without time or id makes its session a broken one, wherever it stands; a null path comes first.
    keys = [(0,) if lack else (1, when, p is not None, p or [], near, k, u) for lack, when, p, near, k, u in zip(lacks, ts, path, anchor, pos, uuid)]
    take: list[int] = []
    no: list[int] = []
    bad: list[bool] = []
    i, n = 0, len(sess)
    while i < n:
        j = i
        while j < n and sess[j] == sess[i]:
            j += 1
        one_of: dict[tuple, int] = {}  # of each moment one message
        for x in range(i, j):
            one_of.setdefault(keys[x][:2], x - i)
        moments = sorted(one_of)
        answers = {m: [one_of[moments[k - 1]]] if k else [] for k, m in enumerate(moments)}
        order, left = kahn(keys[i:j], [answers[k[:2]] for k in keys[i:j]])
        last = 0
        for k, x in enumerate(order):
            r = role[i + x]
            take.append(i + x)
            no.append(k + 1)
            bad.append(lacks[i + x] or bool(r and last))
            last = r
        for k, x in enumerate(left):
            take.append(i + x)
            no.append(len(order) + k + 1)
            bad.append(True)
        i = j
    at = pa.array(take, pa.int32())
    cols = [pa.array([part] * n, pa.int32()), t.column(0).take(at).combine_chunks(), own_ts.take(at).combine_chunks(), t.column(2).take(at).combine_chunks(), t.column(3).take(at).combine_chunks(), pa.array(no, pa.int32()), pa.array(bad, pa.bool_())]
    yield pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in cols], ["part", "session_id", "ts", "uuid", "role", "local_no", "bad"])
