import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomstone.functions.pii import regex_pass
from loomstone.operators import drafts, sessions
from loomstone.sources import files


def run(spark, value, kind, e):
    return spark.createDataFrame([(value,)], f"v {kind}").select(e.alias("x")).first()[0]


V = F.col("v")


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 150).map(lambda n: "a" * n), max_size=6))
def test_insights_never_exceed(spark, parts):
    r = run(spark, parts, "array<string>", drafts.insights(V, 200))
    clean = [p for p in parts if p]
    whole = "\n\n".join(clean)
    assert len(r.text) <= 200
    if len(whole) <= 200:
        assert r.text == whole and not r.truncated and r.omitted == 0
    else:
        assert r.truncated


def test_insights_marker(spark):
    r = run(spark, ["a" * 150, "b" * 100, "c" * 10], "array<string>", drafts.insights(V, 250, F.lit("p ")))
    assert r.text == "p " + "a" * 150 + "\n\n" + "c" * 10 + "\n\n[1 part omitted]" and r.omitted == 1
    assert run(spark, None, "array<string>", drafts.insights(V, 250)).text == ""


def test_checks(spark):
    e = drafts.first_failure([("one", F.when(V > 5, "big")), ("two", F.when(V > 3, "some"))])
    assert run(spark, 6, "int", e).rule_id == "one" and run(spark, 4, "int", e).rule_id == "two" and run(spark, 1, "int", e) is None
    assert run(spark, 6, "int", drafts.all_failures([("one", F.when(V > 5, "x")), ("two", F.when(V > 3, "x"))])) == ["one", "two"]
    assert run(spark, "the VPN register", "string", drafts.few_citations(V, F.array(F.lit("VPN here"), F.lit("Registers"), F.lit("register")))) is None
    assert run(spark, "none", "string", drafts.few_citations(V, F.array(F.lit("VPN here")))) == 0
    assert run(spark, ["a b", "c"], "array<string>", drafts.few_words(V, 4)) == 3


def test_unattributed_numbers(spark):
    assert drafts.unattributed("It grew to 12,500 users.") == (11, "12,500")
    assert drafts.unattributed("A survey saw 12,500 users.") is None
    assert drafts.unattributed("The resource saw 12500 users.") == (17, "12500")
    assert drafts.unattributed("code AADSTS50158 of v2024 and 999") is None
    assert drafts.unattributed("see www.x.example for 2025") is None and drafts.unattributed("As per the memo, 12500 of them") is None
    assert drafts.unattributed("12500 users" + " " * 195 + "a source") == (0, "12500")
    assert drafts.unattributed("12500 users" + " " * 180 + "a source") is None
    assert drafts.unattributed("see https://x.example for 2025") is None
    r = run(spark, "In 2025 it was", "string", drafts.unattributed_number(V))
    assert (r.offset, r.number) == (3, "2025") and run(spark, None, "string", drafts.unattributed_number(V)) is None


def plain_unattributed(text, window=200):
    for m in re.finditer(r"\b\d[\d,]*(?:\.\d+)?\b", text, re.ASCII):
        near = text[max(0, m.start() - window) : m.end() + window]
        if sum(c.isdigit() for c in m[0]) >= 4 and not any(re.search(rf"\b{c}\b", near, re.I | re.ASCII) for c in drafts.CUES) and not re.search(r"(https?://|www\.)\S+", near, re.I):
            return m.start(), m[0]
    return None


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["12,500 ", "12500", "1.2345", "source ", "re", "per ", " ", "x" * 190, "https://x ", "www. ", "Study", "-", "."]), max_size=12).map("".join))
def test_unattributed_against_plain(text):
    assert drafts.unattributed(text) == plain_unattributed(text)


def test_voice_and_titles(spark):
    assert run(spark, "Then I fixed it", "string", drafts.no_first_person(V)) is None and run(spark, "so We did", "string", drafts.no_first_person(V)) is None
    assert run(spark, "the i in it", "string", drafts.no_first_person(V)) is not None
    p = {"Secret": r"(?i)(?<!\w)secret(?!\w)", "Hack": r"(?i)(?<!\w)hack(?!\w)"}
    assert run(spark, "A hack, no secret", "string", drafts.title_words(V, p)) == "Secret" and run(spark, "secretly", "string", drafts.title_words(V, p)) is None


def test_label(spark):
    r = run(spark, ["the VPN register", "VPN again", "register"], "array<string>", drafts.keyword_label(V))
    assert r.label == "register vpn" and r.keywords == ["register", "vpn"]


def test_export(spark):
    s = spark.createDataFrame([("a", 1, False, "t", False, "/ok"), ("b", 0, False, "t", False, "/ok"), ("c", 1, False, "t", False, "/ok")], "session_id string, n_transcripts int, slug_blocked boolean, first_text string, meta_missing boolean, cwd string")
    e = spark.createDataFrame([(i, 0, "user_text", "/ok", f"mail a{n}@b.example " + "x" * 300, None) for i in "ab" for n in range(3)] + [("a", 0, "tool_call", "/ok", None, "to q@b.example " + "y" * 80), ("c", 0, "user_text", "/ok", "x", None)], "session_id string, depth int, kind string, cwd string, text string, summary string")
    red, audit = sessions.export(s, e, ["/ok"], [], lambda c: regex_pass(c)["text"])
    assert {r.session_id: r.drop_reason for r in audit.collect()} == {"a": None, "b": "no_transcripts", "c": "tiny_session"}
    silent = s.where("session_id = 'a'").withColumn("session_id", F.lit("silent"))  # without any text event
    assert [r.drop_reason for r in sessions.export(silent, e, ["/ok"], [], lambda c: c)[1].collect()] == ["tiny_session"]
    rows = red.collect()
    assert len(rows) == 4 and all("@" not in (r.text or "") + (r.summary or "") and len(r.summary or "") <= 80 for r in rows)


def test_discovery_and_folders(spark, tmp_path):
    (tmp_path / "x" / "local_a" / "deep").mkdir(parents=True)
    (tmp_path / "x" / "local_a" / "deep" / "t.jsonl").write_text("{}")
    (tmp_path / "x" / "local_a.json").write_text('{"sessionId":"a"}')
    (tmp_path / "local_b").mkdir()
    (tmp_path / "local_b" / "t.jsonl").write_text("{}")
    far = tmp_path / "1" / "2" / "3" / "4" / "local_far"
    far.mkdir(parents=True)
    (far / "t.jsonl").write_text("{}")
    got = {r.folder.rsplit("/", 1)[1]: r.meta for r in files.discover_sessions(spark, str(tmp_path)).collect()}
    assert got == {"local_a": '{"sessionId":"a"}', "local_b": None}
    w = spark.createDataFrame([("In",), ("Gone",)], "display_name string")
    f = spark.createDataFrame([("In", "1")], "display_name string, id string")
    ok, missing = sessions.resolve_folders(w, f)
    assert [tuple(r) for r in ok.collect()] == [("In", "1")] and [r[0] for r in missing.collect()] == ["Gone"]


def test_dispatches(spark):
    lines = spark.createDataFrame([("p", "u", [("tool_use", None, "Agent", "t1", '{"prompt":"Do it"}'), ("tool_use", None, "Read", "t2", "{}")])], "path string, uuid string, blocks array<struct<type string, text string, name string, id string, input string>>")
    assert [tuple(r) for r in sessions.dispatches(lines).collect()] == [("p", "u", "t1", "Do it")]


def test_question_failures(spark):
    def fails(question, specifics, text):
        df = spark.createDataFrame([(question, specifics, text)], "q string, s array<string>, t string")
        return df.select(drafts.question_failures(F.col("q"), F.col("s"), F.col("t"), 5).alias("f")).first().f

    assert fails("How was the VPN?", ["vpn"], "The VPN broke") == []
    assert fails("one two three four five six", ["", "x"], "none") == ["word_count", "hallucinated_specific"]
    assert fails("Anything interesting?", [], "t") == ["no_specifics", "generic_phrase"] and fails("q", None, None) == ["no_specifics"]
    assert fails("q", ["a"], None) == ["hallucinated_specific"]


def test_category_and_brief(spark):
    rules = {"one": ["a1", "a2"], "two": ["b1", "b2"]}
    assert run(spark, "B1 and b2 and a1", "string", drafts.category(V, rules)) == "two" and run(spark, "b1 a1", "string", drafts.category(V, rules)) == "one" and run(spark, "c", "string", drafts.category(V, rules)) is None
    made = run(spark, " x ", "string", drafts.brief(F.lit("k"), F.lit("t"), V, F.lit(" "), F.lit(None).cast("string"), "Here", "en"))
    assert made == '{"focusKeyword":"k","location":"x","language":"en","insightsText":"t"}'


def test_scaffold_and_composition(spark):
    import datetime as dt

    at = lambda n: dt.datetime(2026, 1, 1, 0, n)
    rows = [("s", at(0), [0], "a", "user_text", sessions.SCAFFOLD + " It went on.", None, None), ("s", at(1), [1], "b", "assistant_text", "yes", None, None), ("s", at(2), [2], "c", "tool_call", None, "Read", "/f"), ("s", at(3), [3], "d", "tool_call", None, "Read", None),
            ("t", at(0), [0], "e", "user_text", "hi", None, None), ("t", at(1), [1], "f", "user_text", sessions.SCAFFOLD, None, None), ("u", at(0), [0], "g", "assistant_text", sessions.SCAFFOLD, None, None)]
    e = spark.createDataFrame(rows, "session_id string, ts timestamp, path array<int>, uuid string, kind string, text string, tool string, summary string")
    kept, marked = sessions.without_scaffold(e)
    assert sorted(r.uuid for r in kept.collect()) == list("bcdefg") and {r.session_id: r.stripped for r in marked.collect()} == {"s": True, "t": False, "u": False}
    assert {r.session_id: r.text for r in sessions.composed(kept, "session_id").collect()}["s"] == "ASSISTANT: yes\n\nTOOL[Read]: /f"
    assert sessions.without_scaffold(e.limit(0))[0].count() == 0
