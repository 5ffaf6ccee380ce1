import datetime as dt
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomstone.functions import arrays as A
from loomstone.functions import dates as D
from loomstone.functions import pii
from loomstone.functions import text as X
from loomstone.operators import chunking


def one(spark, value, kind, *exprs):
    df = spark.createDataFrame([(value,)], f"v {kind}")
    r = df.select(*[e.alias(f"c{i}") for i, e in enumerate(exprs)]).first()
    return r[0] if len(exprs) == 1 else tuple(r)


V = F.col("v")


def test_html(spark):
    html = "<style>p{}</style><p>Tom &amp;lt; Ann&nbsp;&#39;x&#39;</p><script>alert('<b>')</script >\n end"
    assert one(spark, html, "string", X.strip_html(V)) == "Tom < Ann 'x' end"
    assert one(spark, None, "string", X.strip_html(V)) is None
    assert one(spark, "a<b&c>", "string", X.escape_html(V)) == "a&lt;b&amp;c&gt;"


def test_words_and_cuts(spark):
    assert one(spark, "  a\u00a0b\t c ", "string", X.word_count(V)) == 3
    assert one(spark, "", "string", X.word_count(V)) == 0
    assert one(spark, "a b c", "string", X.first_words(V, 2)) == "a b…"
    assert one(spark, "a b", "string", X.first_words(V, 2)) == "a b"
    assert one(spark, "x  y " * 40, "string", F.length(X.clamp(V))) == 80
    assert one(spark, "One two. Three four five", "string", X.cut_at_boundary(V, 14)) == "One two."
    assert one(spark, "One two three four", "string", X.cut_at_boundary(V, 10)) == "One two"
    assert one(spark, "abcdefghij", "string", X.cut_at_boundary(V, 4)) == "abcd"


def test_tokens(spark):
    got = one(spark, "The VPN a1b ab Register register company Kx", "string", X.distinctive_tokens(V))
    assert got == ["vpn", "a1b", "register"]
    assert one(spark, "Therefore several solutions", "string", X.distinctive_tokens(V)) == ["several"]
    assert one(spark, "How to keep the risk register", "string", X.gap_tokens(V)) == ["keep", "risk", "register"]
    assert one(spark, "what were who been", "string", X.gap_tokens(V)) == ["what", "who"]


def test_paths(spark):
    p = "C:\\Work\\\\Client/"
    assert one(spark, p, "string", X.under_any(V, ["c:/work"])) is True
    assert one(spark, p, "string", X.under_any(V, [""])) is False
    assert one(spark, None, "string", X.under_any(V, ["c:/work"])) is False
    r = one(spark, "/a/projects/x-sessions-calm/subagents/agent-acompact-1.jsonl", "string", X.transcript_class(V))
    assert (r.kept, r.is_subagent, r.is_compact, r.slug) == (True, True, True, "calm")
    u = "12345678-1234-1234-1234-123456789abc"
    assert one(spark, f"/a/{u}/b/leaf.json", "string", X.workspace_of(V)) == u
    assert one(spark, f"/a/{u}", "string", X.workspace_of(V)) is None


def test_tool_summary(spark):
    cases = [
        ("Bash", '{"command":"ls\\npwd"}', "bash (multi-line)"), ("Bash", '{"command":"ls  -l\\n \\n"}', "ls -l"), ("mcp__workspace__bash", '{"command":"x"}', "x"), ("Bash", '{"command":" \\n"}', None), ("Bash", '{"command":7}', None),
        ("bash", '{"command":"ls"}', None), ("Read", '{"file_path":"/a"}', "/a"), ("Edit", '{"file_path":""}', None), ("Unknown", "{}", None), ("WebFetch", '{"url":"' + "u" * 90 + '"}', "u" * 80),
        ("mcp__mail__search", '{"query":"q"}', "q"), ("mcp____search", '{"query":"q"}', None), ("WebSearch", '{"query":["q"]}', None), ("Grep", '{"pattern":"p"}', "p"),
        ("mcp__cowork__present_files", '{"files":[{"file_path":"/a"},"/b",{"x":1},3]}', "/a, /b"), ("mcp__cowork__present_files", '{"files":[]}', None), ("mcp__cowork__present_files", '{"files":"x"}', None),
        ("TaskUpdate", '{"title":"t"}', "t"), ("TaskCreate", '{"subject":"s","title":"t"}', "s"), ("AskUserQuestion", '{"questions":[{"question":"q?"}]}', "q?"), ("AskUserQuestion", '{"questions":[]}', None), ("Bash", "not json", None), ("Bash", None, None), (None, "{}", None),
    ]
    df = spark.createDataFrame([(i, t, p) for i, (t, p, _) in enumerate(cases)], "i int, t string, p string")
    got = [r[0] for r in df.orderBy("i").select(X.tool_summary(F.col("t"), F.col("p"))).collect()]
    assert got == [want for *_, want in cases]


def test_titles_and_ids(spark):
    assert one(spark, ' "Quoted" ', "string", X.clean_title(V, F.lit("f"))) == "Quoted"
    assert one(spark, ' "" ', "string", X.clean_title(V, F.lit("f"))) == "f"
    assert one(spark, 12345, "int", X.chunk_source_id(F.lit("s"), F.lit("k"), V)) == "s:k:chunk-12345"
    assert one(spark, 7, "int", X.chunk_source_id(F.lit("s"), F.lit("k"), V)) == "s:k:chunk-0007"
    assert one(spark, "x ```json\n{}\n``` y", "string", X.fenced_json(V)) == "{}"
    assert one(spark, "A. B.\n\nC d", "string", X.place_of(V, F.lit(8))) == "paragraph 2, sentence 1"


def test_earliest_phrase(spark):
    r = one(spark, "Now By The Way it kept", "string", X.earliest_phrase(V, ["kept", "by the way", "by the"]))
    assert (r.pos, r.phrase) == (5, "by the way")
    assert one(spark, "none", "string", X.earliest_phrase(V, ["kept"])) is None


def test_dates(spark):
    d = dt.date(2026, 1, 5)  # a Monday
    assert one(spark, d, "date", D.next_monday(V)) == d
    assert one(spark, dt.date(2026, 1, 6), "date", D.next_monday(V)) == dt.date(2026, 1, 12)
    assert one(spark, dt.date(2026, 1, 9), "date", D.add_business_days(V, 1)) == dt.date(2026, 1, 12)
    assert one(spark, dt.date(2026, 1, 12), "date", D.add_business_days(V, -1)) == dt.date(2026, 1, 9)
    assert one(spark, dt.date(2026, 1, 10), "date", D.add_business_days(V, 0)) == dt.date(2026, 1, 10)
    # both sides of the change of clocks in March 2026
    for day, utc in (("2026-03-02 12:30:00", "2026-03-02 13:00:00"), ("2026-03-02 13:30:00", "2026-03-09 12:00:00"), ("2026-03-08 20:00:00", "2026-03-09 12:00:00")):
        got = one(spark, day, "string", D.next_monday_8am(V.cast("timestamp")).cast("string"))
        assert got == utc
    assert one(spark, 187, "int", D.minutes_to_read(V)) == 1 and one(spark, 188, "int", D.minutes_to_read(V)) == 2
    assert one(spark, None, "int", D.minutes_to_read(V)) == 1
    assert one(spark, "2026-01-02T03:04:05.006Z", "string", D.is_iso_millis(V)) is True
    assert one(spark, "2026-13-02T03:04:05.006Z", "string", D.is_iso_millis(V)) is False
    assert one(spark, "1767225600000", "string", D.any_timestamp(V).cast("string")) == "2026-01-01 00:00:00"
    assert one(spark, 10, "int", D.backoff_ms(100, V, 5000)) == 5000.0


def test_arrays(spark):
    assert one(spark, [3.0, 4.0], "array<float>", A.cosine(V, V)) == pytest.approx(1.0)
    assert one(spark, [0.0, 0.0], "array<float>", A.cosine(V, V)) == 0.0
    assert one(spark, [1.0], "array<float>", A.cosine(V, F.array(F.lit(1.0), F.lit(2.0)))) is None
    assert one(spark, "[]", "string", A.vector_of(V)) == []
    assert one(spark, '["a","b"]', "string", A.all_strings(V)) is True
    assert one(spark, '["a",1]', "string", A.all_strings(V)) is False
    assert one(spark, "nope", "string", A.all_strings(V)) is False
    r = one(spark, "cnfm:3:a", "string", A.callback(V))
    assert (r.question_index, r.choice) == (3, "anon")
    assert one(spark, "cnfm:0:y", "string", A.callback(V)) is None and one(spark, "x", "string", A.callback(V)) is None
    assert one(spark, ["c", "a", "b"], "array<string>", A.first_alphabetical(V)) == ["a", "b"]
    assert one(spark, ["c", "a"], "array<string>", A.first_alphabetical(V)) == ["c", "a"]
    r = one(spark, '{"label":"L","topicKeywords":["a"]}', "string", A.valid_label(V))
    assert (r.label, r.keywords) == ("L", ["a"])
    assert one(spark, '{"label":"L","topicKeywords":[""]}', "string", A.valid_label(V)) is None


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text("ab c", max_size=8), max_size=8), st.integers(0, 20))
def test_greedy_fill(spark, parts, budget):
    kept, used, omitted = [], 0, 0
    for p in (x.strip(" ") for x in parts):
        if p and used + len(p) <= budget:
            kept.append(p)
            used += len(p)
        elif p:
            omitted += 1
    r = one(spark, parts, "array<string>", A.greedy_fill(V, budget))
    assert (r.kept, r.used, r.omitted) == (kept, used, omitted)


def plain_scan(text):
    """The rules of the pattern pass, one candidate at a time."""
    cands = []
    for prio, (kind, pattern, check) in enumerate(pii.RULES):
        at = 0
        rx = re.compile(pattern, re.ASCII)
        while m := rx.search(text, at):
            if check is None or check(m[0]):
                cands.append((m.start(), -(m.end() - m.start()), prio, m.end(), kind))
            at = max(m.end(), at + 1)
    out = []
    while cands:
        c = min(cands)
        out.append((c[0], c[3], c[4]))
        cands = [x for x in cands if x[0] >= c[3]]
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a.b@c.example", "+14165550123", "(416) 555-0123", "416-555-0123", "4165550123", "046-454-286", "046-454-287", "4111 1111 1111 1111", "4111 1111 1111 1112", "10.0.0.255", "10.0.0.256", "fe80:1:2:3", " ", "x", ".", "1"]), max_size=9).map("".join))
def test_pattern_pass(text):
    assert pii.scan(text) == plain_scan(text)


def test_pattern_pass_log(spark):
    r = one(spark, "é a@b.example and 4111 1111 1111 1111 end", "string", pii.regex_pass(V))
    assert r.status == "redacted" and r.text == "é [REDACTED_EMAIL] and [REDACTED_CC]end"
    assert [(x.type, x.offset) for x in r.log] == [("email", 2), ("cc", 18)]
    for text, kind in [("(416) 555.1234", "phone"), ("(416) 555 1234", "phone"), ("(416)555-1234", "phone"), ("192.168.001.001", "ipv4"), ("fe80:1:2:3", "ipv6")]:
        r = one(spark, text, "string", pii.regex_pass(V))
        assert [(x.type, x.replacement) for x in r.log] == [(kind, "[REDACTED_PHONE]" if kind == "phone" else "[REDACTED_IP]")] and one(spark, text, "string", pii.types_found(V)) == [kind]
    assert one(spark, None, "string", pii.types_found(V)) == []
    r = one(spark, None, "string", pii.regex_pass(V))
    assert r.text is None and r.log == []
    assert one(spark, "4111-1111 1111 1111", "string", pii.luhn_ok(V)) is True
    assert one(spark, "", "string", pii.luhn_ok(V)) is False


def plain_windows(text, target, overlap, most):
    """One window after the other, sentence ends looked up one by one."""
    tokens = chunking.default_tokenizer()(text)
    ends, at = {}, 0
    for i, t in enumerate(tokens):
        at += len(t)
        ends[at] = i + 1
    stops = [ends[len(text[: m.end()].encode())] for m in re.finditer(r"[.!?]+|[\n\r]+", text) if m.end() < len(text) and len(text[: m.end()].encode()) in ends]
    out, start = [], 0
    while tokens:
        end = len(tokens)
        if end > target and end - start > most:
            near = [s for s in stops if start + target - overlap <= s <= start + most]
            end = min(near, key=lambda s: (abs(s - start - target), s)) if near else start + target
        out.append((start, end, b"".join(tokens[start:end]).decode("utf-8", "replace")))
        if end == len(tokens):
            break
        start = end - overlap
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["word ", "two words. ", "x\n", "end! ", "été. ", "文字。", "🙂 "]), max_size=400).map("".join))
def test_windows(text):
    w = chunking.windows(text, 40, 10, 60)
    assert w == plain_windows(text, 40, 10, 60)
    for s, e, _ in w:
        assert 0 < e - s <= 60
    with pytest.raises(ValueError):
        chunking.windows(text, 10, 10, 20)


def test_provider_calls_are_made_again(spark):
    calls = []

    def provider(texts):
        calls.append(len(texts))
        if len(calls) == 1:
            raise OSError
        return chunking.hashing_embedder(texts)

    run = chunking.with_attempts(provider, 2, 0)
    assert len(run(["a", "b"])) == 2 and calls == [2, 2]
    with pytest.raises(OSError):
        calls.clear()
        chunking.with_attempts(provider, 1, 0)(["a"])


def test_typed_objects(spark):
    fields = {"a": "string", "b": "text", "c": "boolean", "d": "strings", "e": ["x", "y"]}
    good = '{"a":"","b":"t","c":false,"d":["p"],"e":"y","more":1}'
    r = one(spark, good, "string", A.typed_object(V, fields))
    assert (r.a, r.b, r.c, r.d, r.e) == ("", "t", False, ["p"], "y")
    for old, new in (('"a":""', '"a":1'), ('"b":"t"', '"b":""'), ('"c":false', '"c":"false"'), ('["p"]', '["p",1]'), ('["p"]', '"p"'), ('"e":"y"', '"e":"z"'), ('"e":"y",', ""), ('"a":""', '"a":null')):
        assert one(spark, good.replace(old, new), "string", A.typed_object(V, fields)) is None, new
    for bad in ("[]", "null", "no json", "", None, '"x"'):
        assert one(spark, bad, "string", A.typed_object(V, fields)) is None
    assert one(spark, good.replace('["p"]', "[]"), "string", A.typed_object(V, fields)).d == []


def test_replies_and_commands(spark):
    def reply(kind, choice=None, text=None, transcript=None, url=None):
        df = spark.createDataFrame([(kind, choice, text, transcript, url)], "k string, c string, t string, s string, u string")
        r = df.select(A.reply_record(*map(F.col, "kctsu")).alias("r")).first().r
        return r.response, r.text, r.transcript, r.audio_url, r.confirms, r.needs_text

    assert reply("callback", "anon") == ("anon", None, None, None, True, False) and reply("callback", "skip")[4] is False
    assert reply("callback", None, "t") == ("text", "t", None, None, False, False)
    assert reply("voice", None, None, "said", "u") == ("voice", "said", "said", "u", False, False)
    assert reply("voice", None, None, None, "u") == (None, None, None, "u", False, True)
    assert reply("text", None, "yes") == ("text", "yes", None, None, False, False) and reply(None)[0] == "text"
    assert one(spark, "/Skip@bot x", "string", A.command_of(V)) == "skip" and one(spark, " /skip", "string", A.command_of(V)) is None and one(spark, None, "string", A.command_of(V)) is None


def test_pattern_pass_takes_and_leaves(spark):
    def types(text):
        return [kind for _, _, kind in pii.scan(text)]

    for phone in ("(416) 555-0123", "416-555-0123", "416.555.0123", "4165550123", "+14165550123"):
        assert types(f"ring {phone} today") == ["phone"]
    assert types("a card 4242 4242 4242 4242, a number 1234 5678 9012 3456") == ["cc"]
    assert types("SIN 046-454-286, ISBN 978-3-16-148") == ["sin"]
    assert types("host 192.168.1.42 has v1.2.3") == ["ipv4"] and types("at 999.888.777.666") == []
    assert types("a.b+c@sub.x.co.example and d@y.example") == ["email", "email"] and types("nothing to take") == []


def test_windows_of_plain_words():
    w = chunking.windows("word" + " word" * 2199)
    assert [(s, e) for s, e, _ in w] == [(0, 650), (550, 1200), (1100, 1750), (1650, 2200)]
    for (_, _, a), (_, _, b) in zip(w, w[1:]):
        assert a[-500:] == b[:500]
    w = chunking.windows("The clerk closes the ledger of the branch every single evening. " * 190)
    assert len(w) > 2 and all(re.search(r"[.!?]\s*$", t) for _, _, t in w[:-1])
    w = chunking.windows("word" + " word" * 1999 + ".")
    assert w[0][:2] == (0, 650) and not w[0][2].endswith(".") and chunking.windows("") == [] and chunking.windows("short text.") == [(0, 3, "short text.")]
