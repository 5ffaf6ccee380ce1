import datetime as dt
import json
import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from loomstone import storage

from loomstone.functions import text as X
from loomstone.operators import ingest, redaction, sessions, similarity
from loomstone.operators import tables as T
from loomstone.sources import files
from loomstone.streaming import sessions as stream

TS = dt.datetime(2026, 1, 1)


def brute(rows, t):
    x = {k: np.asarray(v, float) for k, v in rows if k is not None and v}
    out = {}
    keys = sorted(x)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            n = np.linalg.norm(x[a]) * np.linalg.norm(x[b])
            if n and x[a] @ x[b] / n > t:
                out[(a, b)] = x[a] @ x[b] / n
    return out


def test_links_against_brute_force(spark):
    rng = np.random.default_rng(0)
    centers = rng.standard_normal((6, 8))
    rows = [(i, [float(v) for v in centers[i % 6] + 0.4 * rng.standard_normal(8)]) for i in range(200)]
    rows += [(200, rows[0][1]), (201, [0.0] * 8), (202, None), (203, []), (None, rows[0][1]), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "id int, v array<float>").withColumn("cell", F.lit("clash")).withColumn("a", F.lit(1))
    want = brute(rows, 0.9)
    for size in (20, 8_000):
        got = similarity._blocks(df, "id", "v", 0.9, "pairs", size).collect()
        assert {(r.a, r.b) for r in got} == want.keys() and len(got) == len(want)
    n = {r.id: r.n_links for r in similarity.link_counts(df, "id", "v", 0.9).collect()}
    assert sum(n.values()) == 2 * len(want)
    assert similarity.links(df.limit(0), "id", "v", 0.9).count() == 0


def test_links_where_a_third_are_copies(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in ([1.0, 0, 0, 0] if i % 3 == 0 else rng.standard_normal(4))]) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, v array<float>")
    want = brute(rows, 0.95)
    got = similarity._blocks(df, "id", "v", 0.95, "pairs", 25).collect()  # twelve slices, some on one point
    assert {(r.a, r.b) for r in got} == want.keys() and len(got) == len(want)


def test_chain_of_four_and_a_lone_point(spark):
    at = lambda a: [float(np.cos(a)), float(np.sin(a)), 0.0, 0.0]
    rows = [(i, at(0.4 * i)) for i in range(4)] + [(9, at(3.0)), (10, at(3.1))]
    df = spark.createDataFrame(rows, "id int, v array<float>")
    got = sorted(map(tuple, similarity.clusters(df, "id", "v", 0.72).select("cluster_id", "id", "n").collect()))
    assert got == [(0, 0, 4), (0, 1, 4), (0, 2, 4), (0, 3, 4)]


def test_components_of_a_long_path(spark, monkeypatch):
    e = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a int, b int")
    names = e.selectExpr("concat('n', 1000 + a) AS a", "concat('n', 1000 + b) AS b")
    for few in (similarity.FEW_EDGES, 0):  # in one task, and by rounds
        monkeypatch.setattr(similarity, "FEW_EDGES", few)
        got = {r.node: r.root for r in similarity.components(e).collect()}
        assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}
        assert {r.node: r.root for r in similarity.components(names).collect()}["n1200"] == "n1000"
        assert similarity.components(e.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=60))
def test_smallest_of_random_edges(pairs):
    low = list(range(31))
    for _ in range(31):
        for a, b in pairs:
            low[a] = low[b] = min(low[a], low[b])
    a, b = (np.array([p[i] for p in pairs], int) for i in (0, 1))
    assert similarity._smallest(31, a, b).tolist() == low


def test_score_breaks_ties_by_id(spark):
    m = spark.createDataFrame([("b", TS), ("b", TS), ("a", TS), ("a", TS), ("c", TS)], "cluster_id string, ts timestamp")
    s = similarity.scored(m, "ts", F.lit(TS + dt.timedelta(days=60))).orderBy("rank").collect()
    assert [(r.cluster_id, r.score) for r in s] == [("a", 2.0), ("b", 2.0), ("c", 1.0)]


def test_tables(spark):
    s = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", None, "z"), (None, 9, "n"), ("a", 2, "w")], "k string, t int, v string")
    assert sorted(map(tuple, T.latest_rows(s, "k", ["t"], ["v"]).collect())) == [("a", "y"), ("b", "z")]
    new = T.insert_if_absent(s, s.where("k = 'b'"), "k", ["t"], ["v"])
    assert [tuple(r) for r in new.collect()] == [("a", "x")]
    assert T.insert_if_absent(s.limit(0), s, "k", ["t"], ["v"]).count() == 0
    up = {r.k: r.t for r in T.upsert_max(s.where("k = 'b'"), s, "k", "t").collect()}
    assert up == {"a": 2, "b": None}
    u = "12345678-1234-1234-1234-123456789abc"
    cur = spark.createDataFrame([(u, False), (u[:-1] + "d", True)], "id string, is_deleted boolean")
    req = spark.createDataFrame([(u,), (u[:-1] + "d",), (u[:-1] + "e",), ("bad",), (None,), (u,)], "r string")
    out = T.soft_delete(req, "r", cur, "id", "is_deleted")
    assert {r.r: r.outcome for r in out.collect()} == {u: "ok", u[:-1] + "d": "already_deleted", u[:-1] + "e": "not_found", "bad": "invalid", None: "invalid"}
    after = {r.id: r.is_deleted for r in T.apply_soft_deletes(cur, "id", "is_deleted", out, "r").collect()}
    assert after == {u: True, u[:-1] + "d": True}
    g = T.guarded_update(cur, "is_deleted", F.col("id") == u, F.lit(True)).collect()
    assert all(r.is_deleted for r in g)


def test_redaction_is_closed(spark):
    df = spark.createDataFrame([("Boss@x.example", ["a@b.example"], "hi", "call 416-555-0123"), ("q@x.example", None, "Salary talk", "t"), ("q@x.example", [None], None, "has SECRET"), ("q@x.example", [" BOSS@x.example "], "s", None)], "s string, r array<string>, j string, b string")
    import hashlib

    h = [hashlib.sha256(b"boss@x.example").hexdigest()]
    reason = redaction.block_reason(F.col("s"), F.col("r"), F.col("j"), F.col("b"), h, r"\bsalary\b", ["secret"])
    rows = redaction.redact(df, "b", reason).collect()
    assert [(r.status, r.block_reason) for r in rows] == [("blocked", "sender"), ("blocked", "subject"), ("blocked", "keyword"), ("blocked", "recipient")]
    assert all(r.redacted_text == "" and r.redaction_log == [] for r in rows)
    free = redaction.redact(df, "b", F.lit(None).cast("string")).first()
    assert free.status == "redacted" and free.redacted_text == "call [REDACTED_PHONE]"
    s = spark.createDataFrame([("a",), ("A",), ("",), (None,)], "s string").select(redaction.blocked_slug(F.col("s"), ["a", ""])).collect()
    assert [r[0] is not None for r in s] == [True, False, False, False]


def test_post_check(spark):
    rows = [("keep", "/ok/a", "x" * 500), ("keep", "/ok/a", "y"), ("keep", None, "z" * 900), ("tiny", "/ok", "x"), ("out", "/no", "x" * 600), ("out", "/ok", "x"), ("out", "/ok", "x"), ("deny", "/ok/deny", "x" * 600), ("deny", "/ok", "x"), ("deny", "/ok", "x"), ("nocwd", None, "x" * 600), ("nocwd", "", "x"), ("nocwd", "", None)]
    e = spark.createDataFrame(rows, "session_id string, cwd string, text string")
    got = {r.session_id: r.drop_reason for r in sessions.post_check(e, ["/ok"], ["/ok/deny"]).collect()}
    assert got == {"keep": None, "tiny": "tiny_session", "out": "cwd_majority_outside_allowlist", "deny": "cwd_majority_outside_allowlist", "nocwd": None}
    v = sessions.post_check(e, ["/ok"], ["/ok/deny"])
    n = {r.reason: r.n for r in sessions.drop_summary(v).collect()}
    assert n["kept"] == 2 and n["tiny_session"] == 1 and n["meta_missing"] == 0 and len(n) == 11


def test_keep_or_drop(spark):
    df = spark.createDataFrame([(0, False, "t", False, "/ok"), (1, True, "t", False, "/ok"), (1, False, "<scheduled-task x", False, "/ok"), (1, False, None, True, "/ok"), (1, False, "t", False, "/bad"), (1, False, "t", False, "/else"), (1, False, "t", False, "")], "n int, s boolean, t string, m boolean, c string")
    r = df.select(sessions.keep_or_drop(F.col("n"), F.col("s"), F.col("t"), F.col("m"), F.col("c"), ["/ok"], ["/bad"])).collect()
    assert [x[0] for x in r] == ["no_transcripts", "slug_blocked", "scheduled_task", "meta_missing", "cwd_always_deny", "cwd_not_allowed", None]


def test_stitch_is_one_to_one(spark):
    d = spark.createDataFrame([("s", 0, "t0", "Do the thing now"), ("s", 1, "t1", "Do the thing later"), ("s", 2, "t2", "Other")], "session_id string, ord int, tool_use_id string, prompt string")
    a = spark.createDataFrame([("s", 0, "a0", "Do the thing"), ("s", 1, "a1", "Do the thing"), ("s", 2, "a2", ""), ("s", 3, "a3", "Do the thing")], "session_id string, ord int, subagent_id string, first_text string")
    got = {(r.tool_use_id, r.subagent_id) for r in sessions.stitch(d, a).collect()}
    assert got == {("t0", "a0"), ("t1", "a1"), (None, "a2"), (None, "a3")}


def test_chains(spark):
    t = spark.createDataFrame([("s", "calm", 1, "again", True), ("s", "calm", 2, " first ", False), ("u", "one", 0, "x", False)], "session_id string, slug string, ord int, first_text string, stripped boolean")
    got = {(r.session_id, r.ord): r.continuation_group_id for r in sessions.chain_groups(t).collect()}
    want = spark.range(1).select(X.continuation_group(F.lit("calm"), F.lit("first"))).first()[0]
    assert got == {("s", 1): want, ("s", 2): want, ("u", 0): None}


def good(**more):
    e = [{"kind": "user_text", "ts": "2026-01-01T00:00:00.000Z", "uuid": "1", "text": "hi"}, {"kind": "subagent", "ts": "2026-01-01T00:00:01.000Z", "uuid": "2", "subagentSlug": "s", "events": [{"kind": "tool_call", "ts": "2026-01-01T00:00:02.000Z", "uuid": "3", "tool": "x"}]}]
    return {"schemaVersion": 1, "_exporter": {}, "source": "c", "sessionId": "S", "createdAt": "2026-01-01T00:00:00.000Z", "events": e} | more


def test_documents(spark, tmp_path):
    cases = {"good": good(), "version": good(schemaVersion=2), "key": good(extra=1), "time": good(createdAt="2026"), "long": good(events=[{"kind": "tool_call", "ts": "2026-01-01T00:00:00.000Z", "uuid": "1", "tool": "x", "summary": "s" * 81}]), "kind": good(events=[{"kind": "?"}])}
    for n, d in cases.items():
        (tmp_path / f"{n}.json").write_text(json.dumps(d))
    (tmp_path / "broken.JSON").write_text("{")
    (tmp_path / ".hidden.json").write_text("{}")
    (tmp_path / "_audit-1.json").write_text("{}")
    (tmp_path / "x.tmp-1.json").write_text("{}")
    found = files.discover(spark, str(tmp_path))
    assert found.count() == 7 and files.discover(spark, str(tmp_path), F.lit(dt.datetime(2100, 1, 1))).count() == 0
    docs = files.documents(spark, [r.path for r in found.collect()])
    kinds = {r.path.rsplit("/", 1)[1].split(".")[0]: (r.error_kind, r.issues) for r in docs.collect()}
    assert {k: v[0] for k, v in kinds.items()} == {"good": None, "version": "version", "key": "schema", "time": "schema", "long": "schema", "kind": "schema", "broken": "json"}
    assert kinds["long"][1] == ["events.0.summary: longer than 80"]
    flat = files.flat_events(docs).orderBy("path").collect()
    assert [(list(r.path), r.depth, r.kind) for r in flat] == [([0], 0, "user_text"), ([1], 0, "subagent"), ([1, 0], 1, "tool_call")]
    n = files.write_documents(docs, str(tmp_path / "out"))
    assert n["documents"] == 1 and files.documents(spark, str(tmp_path / "out")).where("error_kind is null").count() == 1


def test_transcripts(spark, tmp_path):
    line = lambda **k: json.dumps({"type": "user", "timestamp": "t", "uuid": "u", "message": {"content": "hi"}} | k)
    ok = [line()] * 39 + ["{bad"] + [""]
    (tmp_path / "a.jsonl").write_text("\n".join(ok))
    (tmp_path / "b.jsonl").write_text("\n".join([line()] * 18 + ["{bad"]))
    blocks = [{"type": "thinking"}, {"type": "text", "text": "yes"}, {"type": "tool_use", "name": "Read", "id": "i", "input": {"file_path": "/f"}}]
    (tmp_path / "c.jsonl").write_text("\n".join([line(type="assistant", message={"content": blocks}), line(isMeta=True), line(type="system"), line(message={"content": [{"type": "tool_result"}]}), line(message={"content": " "})]))
    lines, stats = files.transcript_lines(spark, [str(tmp_path / f"{x}.jsonl") for x in "abc"])
    s = {r.path[-7:]: (r.lines_read, r.lines_failed, r.abandoned) for r in stats.collect()}
    assert s == {"a.jsonl": (40, 1, False), "b.jsonl": (19, 1, True), "c.jsonl": (5, 0, False)}
    kept = sessions.kept_lines(lines)
    assert kept.count() == 40
    ev = sessions.explode_blocks(kept).orderBy("uuid").collect()
    assert [(r.uuid, r.kind, r.text, r.summary) for r in ev] == [("u#1", "assistant_text", "yes", None), ("u#2", "tool_call", None, "/f")]


def test_session_meta(spark):
    df = spark.createDataFrame([('{"sessionId":"s","createdAt":"1767225600000","lastActivityAt":"2026-01-02T00:00:00.000Z","mcpServers":[{"name":"m"},{"x":1}]}',)], "p string")
    r = files.session_meta(df, "p").select("session_id", F.col("created_at").cast("string").alias("c"), "mcp_servers").first()
    assert tuple(r) == ("s", "2026-01-01 00:00:00", ["m"])


MAIL = "id string, subject string, body_type string, body string, sender string, recipients array<string>, sent_at string, received_at string, web_link string, folder string, is_draft boolean"


def test_messages(spark, tmp_path):
    def m(i, **k):
        return {"id": i, "subject": "s", "body": {"contentType": "html", "content": "<p>Call 416-555-0123 now</p>"}, "from": {"emailAddress": {"address": "a@b.example"}}, "sentDateTime": "2026-01-01T00:00:00Z"} | k

    page = {"value": [m("1"), m("1"), m("2", isDraft=True), m("3", body={"contentType": "text", "content": " "}), m(None), m("5", sentDateTime=None), m("6", subject="salary")]}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.json").write_text(json.dumps(page))
    from loomstone.sources.mailbox import MailboxSource, first_url, retry_after
    from loomstone.session import ship

    ship(spark)
    spark.dataSource.register(MailboxSource)
    df = spark.read.format("mailbox").option("path", str(tmp_path)).option("folders", "in").load()
    none = spark.createDataFrame([], "source_id string")
    new, counts = ingest.messages(df, none, [], "salary", [])
    rows = new.collect()
    assert [r.source_id for r in rows] == ["msgraph-email:1:chunk-0000"] and rows[0].redacted_text == "Call [REDACTED_PHONE] now" and len(rows[0].embedding) == 64
    assert {r.status: r.n for r in counts.collect()} == {"flowing": 2, "skipped_draft": 1, "skipped_empty": 1, "failed": 2, "blocked": 1}
    again, _ = ingest.messages(df, new.select("source_id"), [], "salary", [])
    assert again.count() == 0
    assert "%24filter=sentDateTime%20ge%202026" in first_url("https://m.example", "in", "2026")
    assert retry_after("3", 0) == 3 and retry_after("Thu, 01 Jan 1970 00:00:10 GMT", 4) == 6 and retry_after("x", 0) is None


EVENTS = [("k", 0, "asked", "q1", None), ("k", 1, "reply", "", "yes"), ("k", 2, "asked", "q2", None), ("k", 10, "reply", "", "late"), ("j", 0, "asked", "q3", None), ("j", 1, "skip", "", None), ("j", 2, "asked", "q4", None), ("j", 3, "asked", "q5", None), ("z", 40, "asked", "q6", None)]


def log(spark):
    return spark.createDataFrame([(k, TS + dt.timedelta(days=d), n, r, t) for k, d, n, r, t in EVENTS], stream.EVENT)


WANT = {("k", "q1", "replied"), ("k", "q2", "timeout"), ("j", "q3", "skipped"), ("j", "q4", "superseded")}


def plain_replay(rows):
    out = []
    for key in {r[0] for r in rows if r[0] is not None}:
        pending = None
        for _, ts, name, ref, text in sorted((r for r in rows if r[0] == key and r[1] is not None), key=lambda r: r[1:4]):
            pending, got = stream.step(pending, round((ts - dt.datetime(1970, 1, 1)).total_seconds() * 1000), name, ref, text)
            out += [(key, *g) for g in got]
    return sorted(out, key=repr)


def test_replay(spark):
    assert {(r.key, r.ref, r.outcome) for r in stream.replay(log(spark)).collect()} == WANT
    assert stream.replay(log(spark).limit(0)).count() == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["k", "j", None]), st.integers(0, 60), st.sampled_from(["asked", "reply", "skip", "other"])), max_size=30))
def test_replay_equals_the_steps(spark, events):
    rows = [(k, None if d == 60 else TS + dt.timedelta(hours=11 * d), n, f"r{i:02d}", f"t{i}") for i, (k, d, n) in enumerate(events)]
    got = stream.replay(spark.createDataFrame(rows, stream.EVENT)).collect()
    got = sorted([(r.key, r.ref, r.outcome, round((r["at"] - dt.datetime(1970, 1, 1)).total_seconds() * 1000), r.text) for r in got], key=repr)
    assert got == plain_replay(rows)


def test_stream_equals_replay(spark, tmp_path):
    log(spark).coalesce(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(stream.EVENT).parquet(str(tmp_path / "in"))
    q = stream.watch(src).writeStream.format("memory").queryName("watched").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.key, r.ref, r.outcome) for r in spark.table("watched").collect()}
    # The watermark of the last event also ends the wait of q5.
    assert got == WANT | {("j", "q5", "timeout")}
    q = stream.without_repeats(src, "ref", "ts", "400 days").writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("once").count() == len({e[3] for e in EVENTS})


def test_windows_and_runs(spark):
    n = {(str(r.window_start)[:10], r.key): r.n for r in stream.counts_per_window(log(spark), "ts", "key", "1 day").collect()}
    assert n[("2026-01-01", "k")] == 1 and len(n) == 9
    a = {(r.key, r.n) for r in stream.activity_sessions(log(spark), "ts", "key", "36 hours").collect()}
    assert a == {("k", 3), ("k", 1), ("j", 4), ("z", 1)}


def test_build_documents(spark):
    s = spark.createDataFrame([("s", None, "w", "t", None, None, None, None, ["m"]), ("none", None, None, None, None, None, None, None, None)], "session_id string, session_slug string, workspace_id string, title string, created_at timestamp, last_activity_at timestamp, model string, account string, mcp_servers array<string>")
    event = "session_id string, path array<int>, depth int, kind string, ts timestamp, uuid string, cwd string, git_branch string, text string, tool string, summary string, subagent_slug string, parent_tool_use_id string"
    rows = [
        ("s", [1], 0, "subagent", TS, "b", "/a", None, None, None, None, "x", "t1"), ("s", [0], 0, "user_text", TS, "a", "/b", "main", "hi", None, None, None, None),
        ("s", [1, 1], 1, "tool_call", TS, "d", None, None, None, "Read", None, None, None), ("s", [1, 0], 1, "user_text", TS, "c", None, "", "in", None, None, None, None),
        ("s", [7, 0], 1, "user_text", TS, "lost", None, None, "no parent", None, None, None, None), ("s", [2], 0, "note", TS, "n", None, None, "unknown kind", None, None, None, None),
    ]
    built = files.build_documents(s, spark.createDataFrame(rows, event))
    d = {r.session_id: json.loads(r.doc) for r in built.collect()}
    h = dict(d["s"])
    tree = h.pop("events")
    assert h.pop("_exporter").keys() == {"name", "version", "sourceFormat", "exportedAt"}
    assert h == {"schemaVersion": 1, "source": "sessions", "sessionId": "s", "workspaceId": "w", "title": "t", "createdAt": "2026-01-01T00:00:00.000Z", "cwds": ["/a", "/b"], "gitBranches": ["main"], "mcpServers": ["m"]}
    assert [e["uuid"] for e in tree] == ["a", "b"] and [e["uuid"] for e in tree[1]["events"]] == ["c", "d"] and "summary" not in tree[1]["events"][1]
    assert d["none"]["events"] == []
    back = files.flat_events(files.judged(built.select(F.col("session_id").alias("path"), "doc")))
    assert [tuple(r) for r in back.orderBy("path").select("uuid", "depth").collect()] == [("a", 0), ("b", 0), ("c", 1), ("d", 1)]


def test_inner_events_are_judged(spark):
    doc = {"schemaVersion": 1, "_exporter": {}, "source": "s", "sessionId": "s", "createdAt": "2026-01-01T00:00:00.000Z"}
    event = lambda **k: {"ts": "2026-01-01T00:00:00.000Z", "uuid": "u"} | k
    inner = event(kind="subagent", subagentSlug="x", parentToolUseId="t", events=[event(kind="user_text", text=""), event(kind="tool_call", tool="T", summary="s" * 81)])
    outer = event(kind="subagent", subagentSlug="x", parentToolUseId="t", events=[inner])
    raw = spark.createDataFrame([("a", json.dumps(doc | {"events": [outer]})), ("b", json.dumps(doc | {"events": [outer | {"events": "no"}]})), ("c", json.dumps(doc | {"events": []}))], "path string, doc string")
    got = {r.path: (r.error_kind, list(r.issues)) for r in files.judged(raw).collect()}
    assert got["a"] == ("schema", ["events.0.events.0.events.0.text: empty", "events.0.events.0.events.1.summary: longer than 80"])
    assert got["b"] == ("schema", ["events.0.events: not an array"]) and got["c"] == (None, [])


def mail(i, minute, **more):
    return {"id": i, "subject": "s", "body": {"contentType": "text", "content": "t"}, "sentDateTime": f"2026-01-01T00:{minute:02d}:00Z"} | more


def test_mailbox_bound_and_checkpoints(spark, tmp_path):
    from loomstone.session import ship
    from loomstone.sources.mailbox import MailboxSource, folder_checkpoints

    ship(spark)
    spark.dataSource.register(MailboxSource)
    for folder, n in (("big", 40), ("small", 1), ("last", 30)):
        (tmp_path / folder).mkdir()
        for k in range(0, n, 10):
            (tmp_path / folder / f"{k:03d}.json").write_text(json.dumps({"value": [mail(f"{folder}{i}", i) for i in range(k, min(n, k + 10))]}))
    read = lambda **o: spark.read.format("mailbox").options(path=str(tmp_path), folders="big,small,last", **o).load()
    n = lambda df: {r.folder: r["count"] for r in df.groupBy("folder").count().collect()}
    first = read(most="50")
    assert n(first) == {"big": 40, "small": 1, "last": 9}
    assert n(read(most="0")) == {"big": 40, "small": 1, "last": 30} == n(read())
    at = {r.folder: r.since for r in folder_checkpoints(first).collect()}
    assert at["last"] == "2026-01-01T00:08:00Z"
    rest = read(most="50", since=json.dumps(at))
    assert first.select("id").union(rest.select("id")).distinct().count() == 71  # nothing is lost between runs
    kept = folder_checkpoints(first.where("folder = 'big'"), spark.createDataFrame([("small", "2026"), ("big", "2025")], "folder string, since string"))
    assert {r.folder: r.since for r in kept.collect()} == {"small": "2026", "big": at["big"]}


def test_server_pages():
    from loomstone.sources.mailbox import MailboxError, server_pages

    answers = {"u1": [(429, {"retry-after": "3"}, ""), (503, {}, ""), (200, {}, '{"value":[1],"@odata.nextLink":"u2"}')], "u2": [(200, {}, '{"value":[2]}')], "bad": [(404, {}, "")], "down": [(500, {}, "")] * 4}
    waits = []
    fetch = lambda u: answers[u].pop(0)
    assert [p["value"] for p in server_pages(fetch, "u1", wait=waits.append)] == [[1], [2]] and waits == [3, 2]
    for u in ("bad", "down"):
        with pytest.raises(MailboxError):
            list(server_pages(fetch, u, wait=waits.append))
    assert answers["down"] == []


def test_missing_folder(spark):
    with pytest.raises(AnalysisException):
        files.discover(spark, "/nowhere/at/all")


def test_discards_and_touched_rows(spark):
    df = spark.createDataFrame([(1, "a", TS), (2, None, TS)], "k int, v string, updated_at timestamp")
    kept, gone = T.with_discards(df, F.when(F.col("v").isNull(), "no value"))
    assert [r.k for r in kept.collect()] == [1] and [(r.k, r.reason) for r in gone.collect()] == [(2, "no value")]
    later = TS + dt.timedelta(days=1)
    assert [r.updated_at for r in T.touched(df, F.col("v") == "a", F.lit(later)).orderBy("k").collect()] == [later, TS]


def test_shared_folder():
    import types

    conf = types.SimpleNamespace(get=lambda k, d=None: None)
    no = types.SimpleNamespace(isDefined=lambda: False)
    sc = types.SimpleNamespace(getConf=lambda: conf, master="spark://host:7077", _jsc=types.SimpleNamespace(sc=lambda: types.SimpleNamespace(getCheckpointDir=lambda: no)))
    with pytest.raises(RuntimeError):
        storage.shared_folder(types.SimpleNamespace(conf=conf, sparkContext=sc))


def test_release(spark):
    t = storage.cut(spark.range(3), "numbers")
    assert t.df.count() == 3 and os.path.isdir(t.path.replace("file:", ""))
    t.drop()
    assert not os.path.exists(t.path.replace("file:", ""))


def test_memo_and_outbox(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    assert [storage.memo(spark, str(tmp_path / "step"), build).count() for _ in range(2)] == [3, 3] and built == [1]
    e = spark.createDataFrame([("asked", "1"), ("asked", "1"), ("asked", "2")], "name string, payload string")
    for _ in range(2):
        storage.emit(e, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_settings(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"allow":["/x"],"n":2,"more":1}')
    (tmp_path / "b.json").write_text("{broken")
    a, b = str(tmp_path / "a.json"), str(tmp_path / "b.json")
    assert files.load_config(spark, {"a": a}, {"a": {"allow": list, "n": int}}) == {"a": {"allow": ["/x"], "n": 2}}
    for path, schema in ((str(tmp_path / "none.json"), {}), (b, {}), (a, {"gone": list}), (a, {"n": str}), (a, {"n": list})):
        with pytest.raises(files.ConfigError):
            files.load_config(spark, {"c": path}, {"c": schema})
