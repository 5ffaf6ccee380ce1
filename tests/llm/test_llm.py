import datetime as dt
import random
import re
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomstone.llm import bpe, conversations, lookalikes, mail, mixing, privacy, splitting, surrogates, vectors
from loomstone.session import ship

TS = dt.datetime(2026, 1, 1)


@pytest.fixture(autouse=True, scope="module")
def shipped(spark):
    ship(spark)


# --- vectors -------------------------------------------------------------------------------

SIGNALS = "id string, ingested_at timestamp, is_deleted boolean, embedding array<float>, rid string, h int"


def signal_rows(n=900, dim=128, seed=0):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((n // 12, dim))
    rows = []
    for i in range(n):
        v = centers[i % len(centers)] + 0.45 * rng.standard_normal(dim)
        rows.append((f"s{i:05d}", TS, False, [float(x) for x in v * (3 if i % 7 else 0.5)], "x", 1))
    same = rows[0][3]
    rows += [(f"copy{i:02d}", TS, False, same, "x", 1) for i in range(9)]  # a group of copies
    rows += [(rows[5][0], TS + dt.timedelta(days=1), True, rows[5][3], "x", 1)]  # deleted later
    rows += [(rows[6][0], TS - dt.timedelta(days=1), True, rows[6][3], "x", 1)]  # deleted before: counts not
    rows += [(rows[7][0], TS, False, rows[7][3], "x", 1)]  # repeated
    bad = [None, [], [1.0] * (dim - 1), [0.0] * dim, [float("nan")] + [1.0] * (dim - 1), [float("inf")] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1)]
    rows += [(f"bad{i}", TS, False, v, "x", 1) for i, v in enumerate(bad)]
    rows += [(None, TS, False, same, "x", 1), ("nots", None, None, rows[8][3], "x", 1)]
    return rows


def usable(rows):
    latest = {}
    for i, t, gone, v, *_ in rows:
        if i is not None:
            k = (t or dt.datetime.min, bool(gone))
            if i not in latest or k > latest[i][0]:
                latest[i] = (k, gone, v)
    out = {}
    for i, (_, gone, v) in latest.items():
        if not gone and v is not None and len(v) == 128 and None not in v and np.isfinite(v).all() and np.any(v):
            out[i] = np.asarray(v, float) / np.linalg.norm(v)
    return out


def test_neighbours_and_clusters_against_brute_force(spark):
    rows = signal_rows()
    x = usable(rows)
    ids = sorted(x)
    m = np.stack([x[i] for i in ids])
    cos = m @ m.T
    np.fill_diagonal(cos, -2)
    want = set()
    for i in range(len(ids)):
        order = sorted(range(len(ids)), key=lambda j: (-round(cos[i, j], 6), ids[j]))[:5]
        want |= {tuple(sorted((ids[i], ids[j]))) for j in order if cos[i, j] > 0.72}
    df = spark.createDataFrame(rows, SIGNALS)
    v = vectors.Vectors(df)
    assert v.n == len(ids)
    lists = vectors.most_similar(v, 5, 0.72, leaf=64, visits=24)
    got = {tuple(r) for r in vectors.pairs_by_id(v, lists).collect()}
    assert len(got & want) / len(want) > 0.97 and len(got & want) / len(got) > 0.97
    full = vectors.most_similar(v, 5)
    assert full.groupBy("a").count().where("count <> 5").count() == 0
    # clusters: exact components
    up = list(range(len(ids)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in zip(*np.nonzero(cos > 0.72)):
        a, b = root(i), root(j)
        up[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(root(i), []).append(ids[i])
    want = {(g[0], i) for g in groups.values() if len(g) > 2 for i in g}
    c = vectors.groups_by_id(v, vectors.clusters(v, 0.72, leaf=64, visits=24))
    got = {(r.first_id, r.id) for r in c.collect()}
    assert len(got & want) / len(want) > 0.98
    assert {i for _, i in got} >= {f"copy{i:02d}" for i in range(9)}


def test_recall_of_neighbours_alike_or_not(spark, monkeypatch):
    rows = signal_rows(1500, seed=3)
    x = usable(rows)
    ids = sorted(x)
    m = np.stack([x[i] for i in ids])
    cos = m @ m.T
    np.fill_diagonal(cos, -2)
    v = vectors.Vectors(spark.createDataFrame(rows, SIGNALS))
    name = {r.rid: r.id for r in v.base.select("rid", "id").collect()}
    at = {i: k for k, i in enumerate(ids)}
    fifth = -np.partition(-cos, 4, axis=1)[:, 4]
    # The sample's levels only; levels below them; buckets whose visitors are spread over parts.
    for sample, crowd in ((4000, 10**6), (256, 10**6), (256, 150)):
        monkeypatch.setattr(vectors, "CROWD", crowd)
        f = vectors._fit(v, sample, vectors.TREES, 48, 24, vectors.SEED)
        assert f.depth == 5 and f.deep == (0 if sample > 256 else 5 - f.top) and (f.parts > 1).any() == (crowd == 150)
        if f.deep:
            assert f.deep >= 1 and np.abs(f.deep_at).sum() > 0
        got = vectors.most_similar(v, 5, leaf=48, visits=24, sample=sample).collect()
        assert len({(r.a, r.b) for r in got}) == len(got)
        hits = sum(cos[at[name[r.a]], at[name[r.b]]] >= fifth[at[name[r.a]]] - 1e-4 for r in got)
        assert hits / (5 * len(ids)) > 0.9, (sample, crowd, hits / (5 * len(ids)))
        groups = vectors.groups_by_id(v, vectors.clusters(v, 0.72, leaf=48, visits=24, sample=sample))
        assert groups.count() == groups.select("id").distinct().count() > 200


def test_density_counts_copies(spark):
    rows = signal_rows(200)
    x = usable(rows)
    ids = sorted(x)
    m = np.stack([x[i] for i in ids])
    alike = (m @ m.T > 0.72).sum(axis=1) - 1  # all in one leaf
    v = vectors.Vectors(spark.createDataFrame(rows, SIGNALS))
    got = {r.id: r.density for r in vectors.groups_by_id(v, vectors.clusters(v, 0.72)).collect()}
    assert len(got) > 20 and got == {i: n for i, n in zip(ids, alike) if i in got}
    assert len({got[i] for i in [rows[0][0], *(f"copy{i:02d}" for i in range(9))]}) == 1


def test_vectors_of_nothing_and_of_one(spark):
    for rows in ([], [("a", TS, False, [1.0] * 128, "x", 1)]):
        v = vectors.Vectors(spark.createDataFrame(rows, SIGNALS))
        assert vectors.most_similar(v, 5).count() == 0
        assert vectors.clusters(v, 0.72).count() == 0


def test_only_copies(spark):
    rows = [(f"c{i}", TS, False, [1.0, 2.0] * 64, "x", 1) for i in range(8)]
    v = vectors.Vectors(spark.createDataFrame(rows, SIGNALS))
    n = vectors.most_similar(v, 5, 0.72).groupBy("a").count().collect()
    assert len(n) == 8 and all(r["count"] == 5 for r in n)
    pairs = {tuple(r) for r in vectors.pairs_by_id(v, vectors.most_similar(v, 5, 0.72)).collect()}
    first = [f"c{i}" for i in range(8)]
    assert pairs == {tuple(sorted((a, b))) for a in first for b in [x for x in first if x != a][:5]}
    g = vectors.groups_by_id(v, vectors.clusters(v, 0.72)).collect()
    assert {(r.first_id, r.id, r.n) for r in g} == {("c0", i, 8) for i in first}


def test_labels_of_a_long_path(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(900, 901)], "u long, v long")
    got = {r.node: r.label for r in vectors.smallest_labels(e).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, 901: 900}


# --- splitting -----------------------------------------------------------------------------


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["word ", "ends. ", "line\n", "para\n\n", "文字。", "x" * 40, ", ", "  "]), max_size=300).map("".join))
def test_pieces_tile_the_text(text):
    pieces = splitting.bisect(text, 30, 200, 5, 40)
    assert pieces[0][0] == 0 and pieces[-1][2] == len(text)
    assert "".join(text[own:end] for _, own, end in pieces) == text
    for (_, _, end), (start, own, _) in zip(pieces, pieces[1:]):
        assert start <= own == end and own - start <= 40 and len(splitting.WORD.findall(text[start:own])) <= 5
    big = len(text) > 200 or len(splitting.WORD.findall(text)) > 30
    assert (len(pieces) > 1) == big
    for start, _, end in pieces:
        assert end - start <= 200 and len(splitting.WORD.findall(text[start:end])) <= 30


def test_cut_prefers_the_strongest_boundary():
    text = "one two three. four five\n\nsix seven. eight nine ten"
    assert splitting.bisect(text, 8, 60, 2, 20)[0][2] == text.index("six")


def test_overlap_without_blanks():
    for text in ("x" * 20_000, "e\u0301" * 9_000, "short words here. " * 100 + "y" * 12_000):
        pieces = splitting.bisect(text)
        assert len(pieces) > 2
        for (_, lo, _), (start, own, end) in zip(pieces, pieces[1:]):
            assert lo <= start < own and own - start <= 750 and end - start <= 6_000
            assert text[start] != "\u0301"
            assert len(splitting.WORD.findall(text[start:end])) <= 800


def test_split_table(spark):
    long_word = "x" * 20_000
    rows = [("a", "w " * 801, 1), ("b", "w " * 800, 1), ("c", None, 1), ("d", "", 1), (None, long_word, 1), ("e", long_word, 1), ("e", long_word, 1)]
    df = spark.createDataFrame(rows, "id string, redacted_text string, piece int")
    got = splitting.split(df, "id", "redacted_text").collect()
    assert {r.id for r in got} == {"a", None, "e"} and all(len(r.piece) <= 6000 and r.n_words <= 800 for r in got)
    assert "".join(r.piece[r.own_start - r.start :] for r in sorted((r for r in got if r.id is None), key=lambda r: r.piece_no)) == long_word
    assert splitting.split(df.limit(0), "id", "redacted_text").count() == 0


# --- conversations -------------------------------------------------------------------------

EVENTS = "session_id string, path array<int>, depth int, kind string, ts timestamp, uuid string, text string, part int, role string"


def plain_rebuild(rows):
    by = {}
    for s, path, depth, kind, ts, uuid, text, *_ in rows:
        k = re.sub(r"[-\s]", "_", (kind or "").strip(" ").lower())
        if s is not None and depth == 0 and k in ("user_text", "assistant_text") and text and text.strip(" \t\r\n"):
            by.setdefault(s, []).append((ts, path, uuid, k == "user_text"))
    out = set()
    for s, ms in by.items():
        if any(t is None or not u for t, _, u, _ in ms):
            continue
        one = {}
        for t, p, u, r in sorted(ms, key=lambda m: (m[0], m[1] or [])):
            one.setdefault(u, (t, p or [], u, r))
        o = sorted(one.values(), key=lambda m: m[:3])
        if o[0][3] and all(not a[3] or b is not None and not b[3] for a, b in zip(o, [*o[1:], None])):
            out |= {(s, i + 1, m[2]) for i, m in enumerate(o)}
    return out


def test_rebuild_against_plain(spark):
    rng = random.Random(1)
    rows = []
    for s in range(120):
        n = rng.choice([0, 1, 2, 2, 4, 6]) if s else 400
        for i in range(n):
            kind = ["user_text", "Assistant-Text "][i % 2] if rng.random() > 0.02 else rng.choice(["user_text", "tool_call", None])
            uuid = f"{s}-{i}" if rng.random() > 0.01 or not s else rng.choice([None, "", f"{s}-0"])
            ts = TS + dt.timedelta(seconds=i // 2 if s % 3 == 0 else i) if rng.random() > 0.01 or not s else None
            rows.append((f"s{s}", [i], int(rng.random() > 0.97), kind, ts, uuid, rng.choice(["t"] * 20 + [" ", None]) if s else "t", 1, "x"))
            if rng.random() > 0.9:
                rows.append((f"s{s}", [i + 50], 0, kind, ts, uuid, "t", 1, "x"))
    for k, i in enumerate(range(400)):  # the hot session stays whole
        rows[k] = rows[k]
    rows += [(None, [0], 0, "user_text", TS, "n", "t", 1, "x"), ("one", None, 0, "user_text", TS, "a", "t", 1, "x"), ("one", [1], 0, "assistant_text", TS, "b", "t", 1, "x")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, EVENTS)
    got = {(r.session_id, r.turn_no, r.uuid) for r in conversations.rebuild(df).collect()}
    want = plain_rebuild(rows)
    assert got == want and len({s for s, _, _ in want}) > 20
    assert conversations.rebuild(df.limit(0)).count() == 0


def test_kahn():
    assert conversations.kahn([5, 1, 3], [[], [0], [0]]) == ([0, 1, 2], [])
    assert conversations.kahn([1, 2, 3], [[2], [], [1, 1]]) == ([1, 2, 0], [])
    order, left = conversations.kahn([0, 1, 2, 3], [[], [2], [1], [2]])
    assert order == [0] and left == [1, 2, 3]
    assert conversations.kahn([0], [[0]]) == ([], [0])


def plain_reply_order(msgs, edges):
    """Kahn's algorithm over each whole session, one free message after the other."""
    places, faults = {}, set()
    for s in {m[0] for m in msgs}:
        own = {m[1]: (m[2], m[3], m[1]) for m in msgs if m[0] == s}
        parents = {u: {p for x, c, p in edges if x == s and c == u and p is not None} for u in own}
        if any(p not in own for ps in parents.values() for p in ps):
            faults.add((s, "orphan"))
            parents = {u: ps & own.keys() for u, ps in parents.items()}
        done = []
        while free := [u for u in own if u not in done and parents[u] <= set(done)]:
            done.append(min(free, key=own.get))
        if len(done) < len(own):
            faults.add((s, "cycle"))
        else:
            places[s] = done
    return places, faults


def test_reply_order_against_plain(spark):
    rng = random.Random(4)
    msgs, edges = [], []
    for s in range(60):
        n = rng.choice([1, 3, 8, 15]) if s else 200
        ids = [f"{s}-{i:03d}" for i in range(n)]
        for i, u in enumerate(ids):
            msgs.append((f"s{s}", u, TS + dt.timedelta(hours=5 * (i // 2)), [rng.randrange(3)], i % 2))
            if i and rng.random() < 0.9:
                edges.append((f"s{s}", u, ids[rng.randrange(max(0, i - 4), i)]))
            if i and rng.random() < 0.05:  # answers a later message: the clock was wrong, or a cycle
                edges.append((f"s{s}", u, ids[min(n - 1, i + rng.randrange(4))]))
        if rng.random() < 0.05:
            edges.append((f"s{s}", ids[0], "gone"))
    edges += [("s1", "nobody", "s1-000"), ("s1", None, "x"), ("s1", "1-000", None), *edges[:5], ("no", "a", "b")]
    rng.shuffle(msgs)
    df = spark.createDataFrame(msgs, "session_id string, uuid string, ts timestamp, path array<int>, role int").repartition(5)
    e = spark.createDataFrame(edges, "session_id string, uuid string, parent_uuid string")
    out, faults = conversations.reply_order(df, e)
    want, bad = plain_reply_order(msgs, edges)
    assert {tuple(r) for r in faults.collect()} == bad and {k for _, k in bad} == {"cycle", "orphan"}
    got = {}
    for r in sorted(out.collect(), key=lambda r: (r.session_id, tuple(r["at"].key), r["at"].pos if r["at"].pos is not None else -1)):
        got.setdefault(r.session_id, []).append(r.uuid)
    moved = [s for s in want if want[s] != [m[1] for m in sorted((m for m in msgs if m[0] == s), key=lambda m: (m[2], m[3], m[1]))]]
    assert len(moved) > 5 and {s: got[s] for s in want} == want
    none, _ = conversations.reply_order(df.limit(0), e.limit(0))
    assert none.count() == 0


def test_rebuild_with_named_replies(spark):
    def row(s, n, kind, uuid, minute):
        return (s, [n], 0, kind, TS + dt.timedelta(minutes=minute), uuid, "t", 1, "x")

    rows = []
    for s in ("late", "plain", "cycle", "orphan"):
        rows += [row(s, 0, "user_text", "q1", 0), row(s, 1, "assistant_text", "a1", 1), row(s, 2, "user_text", "q2", 3), row(s, 3, "assistant_text", "a2", 2)]  # a2's clock was wrong
    chain = [("a1", "q1"), ("q2", "a1"), ("a2", "q2")]
    edges = [(s, c, p) for s in ("late", "cycle", "orphan") for c, p in chain] + [("cycle", "q1", "a2"), ("orphan", "q1", "gone")]
    df = spark.createDataFrame(rows, EVENTS)
    e = spark.createDataFrame(edges, "session_id string, uuid string, parent_uuid string")
    got = [(r.session_id, r.turn_no, r.uuid, r.ts.minute) for r in conversations.rebuild(df, e).orderBy("session_id", "turn_no").collect()]
    assert got == [("late", 1, "q1", 0), ("late", 2, "a1", 1), ("late", 3, "q2", 3), ("late", 4, "a2", 2)]
    assert conversations.rebuild(df, e.limit(0)).count() == 0 == conversations.rebuild(df).count()
    assert conversations.rebuild(df.limit(0), e.limit(0)).count() == 0


def test_a_session_over_many_segments(spark):
    n = 5000
    rows = [("hot", [i], 0, ["user_text", "assistant_text"][i % 2], TS + dt.timedelta(seconds=i), f"u{i:05d}", "t", 1, "x") for i in range(n)]
    df = spark.createDataFrame(rows, EVENTS).repartition(7)
    got = conversations.rebuild(df).orderBy("turn_no").collect()
    assert [r.uuid for r in got] == [f"u{i:05d}" for i in range(n)] and got[-1].turn_no == n
    assert conversations.rebuild(df.where("uuid <> 'u02501'")).count() == 0


# --- mail ----------------------------------------------------------------------------------

NEW = "The patch window was replaced. We lost 15 hours.\nOn Monday I wrote: ship it anyway.\n> 40 seats means the higher tier.\nGive my regards to the branch."
CASES = [
    (NEW, set()),
    (f"{NEW}\n\nThanks!", set()),
    (f"{NEW}\n\nKind regards,\n[REDACTED_PERSON]\nIT Manager", {"signature"}),
    (f"{NEW}\n\n-- \nJane Holloway\nT: [REDACTED_PHONE]", {"signature"}),
    (f"{NEW}\n\nSent from my phone", {"signature"}),
    (f"{NEW}\n\nOn 3/4/2026 10:00, [REDACTED_PERSON] wrote:\n> old text here\n> Regards,\n> [REDACTED_PERSON]", {"quoted"}),
    (f"{NEW}\n\n-----Original Message-----\nFrom: [REDACTED_PERSON]\nSent: Monday, May 4, 2026 10:00\nTo: [REDACTED_PERSON]\nSubject: RE: x\n\nold text\n\n--\n[REDACTED_PERSON]", {"quoted"}),
    (f"{NEW}\n\nThis e-mail and any files attached may hold confidential material and are intended only for the addressee.", {"disclaimer"}),
    (f"Le 4 mars 2026 à 10:00, [REDACTED_PERSON] a écrit :\n| ancien texte\n\n{NEW}\n\nCheers,\n[REDACTED_PERSON]", {"quoted", "signature"}),
    ("short text. _____ [REDACTED_PERSON] Some Firm T: [REDACTED_PHONE] On 6/4/2026 12:50, [REDACTED_PERSON] wrote: > old", {"quoted", "signature"}),
    ("| a table | 1 | 2 |\n| b row | 3 | 4 |", set()),
    ("From: 9 am To: 5 pm, that is the whole window.\nKeep this confidential until the audit is over.", set()),
    ("", set()),
    (None, set()),
    (" \n\t", set()),
]


def test_foreign_parts():
    m = mail.MailModel()
    for text, want in CASES:
        assert {s.kind for s in mail.foreign(text, m)} == want, text
    for text, _ in CASES:
        if text and NEW in text:
            assert NEW in mail.newly_written(text, m)
            assert "old text" not in mail.newly_written(text, m)
    assert mail.newly_written(None, m) is None
    assert mail.newly_written(f"Kind regards,\r\n[REDACTED_PERSON]\r\nIT Manager\r\n\r\n{NEW}", m) == NEW
    long = "word " * 300_000 + "\n\nSent from my phone"
    assert {s.kind for s in mail.foreign(long, m)} == {"signature"}


def test_gain_tells_foreign_from_new():
    m = mail.MailModel()
    d = m.of["disclaimer"]
    assert d.gain("We accept no liability for delays or viruses.") > 0.4 > d.gain("The patch window at the depot was replaced twice.")


def test_foreign_parts_without_a_pattern():
    m = mail.MailModel()
    notice = "This message and any enclosures may hold confidential material and is meant only for the named recipient."
    wrapped = notice.replace("material and", "material\nand")
    for text, want in [
        (f"{NEW}\n\n{notice}", {"disclaimer"}),
        (f"{notice}\n\n{NEW}", {"disclaimer"}),
        (f"{NEW}\n\n{wrapped}", {"disclaimer"}),
        (f"{NEW} {notice}", {"disclaimer"}),
        (f"{NEW}\n\nSent with my tablet, please excuse typos", {"signature"}),
        (f"{NEW}\n\nWarm wishes,\n[REDACTED_PERSON]\nIT Manager", {"signature"}),
        (f"{NEW}\n\n[REDACTED_PERSON]\nIT Manager", {"signature"}),
        (f"{NEW}\n\n-- \n{NEW}", set()),
        (f"{NEW}\n\nThanks,", set()),
        (f"{NEW}\n\nThis material is confidential, so keep it in the depot.", set()),
        (f"{NEW}\n\nPlease delete the old rows and tell the clerk.\n\n{NEW}", set()),
    ]:
        assert {s.kind for s in mail.foreign(text, m)} == want, text
        assert NEW in mail.newly_written(text, m)


def strange_mails(n=120):
    """Mails whose closings, notices and introductions are in no list."""
    out = []
    for i in range(n):
        new = f"The depot number {i} got {i * 7 % 50} crates before noon.\nNobody counted them twice on day {i}."
        close = f"Hartelijke groet,\n[REDACTED_PERSON]\nMagazijnchef {i % 3}"
        notice = "If you have received this e-mail in error, please notify the sender and delete it.\nQuibble forms are void after the second moon."
        old = f"Op ma {i % 28 + 1} jan 2025 om {i % 12}:10 schreef [REDACTED_PERSON]:\n> oude tekst {i}\n> en meer"
        out.append("\n\n".join([new, *([close] if i % 2 else []), *([notice] if i % 3 == 0 else []), *([old] if i % 4 == 0 else [])]))
    return out


def test_dictionaries_are_learned():
    m = mail.MailModel(strange_mails())
    plain = mail.MailModel()
    text = "We moved the shelf.\n\nHartelijke groet,\nJan de Vries\nMagazijnchef 1\n\nQuibble forms are void after the second moon."
    assert {s.kind for s in mail.foreign(text, m)} == {"signature", "disclaimer"} and mail.newly_written(text, m) == "We moved the shelf."
    assert mail.foreign(text, plain) == []
    late = "We moved the shelf.\n\nOp di 3 feb 2025 om 4:10 schreef [REDACTED_PERSON]:\n\noude tekst zonder tekens"
    assert {s.kind for s in mail.foreign(late, m)} == {"quoted"} and mail.foreign(late, plain) == []
    marked = late.replace("\n\noude", "\n> oude")  # directly above a marked run the place is enough
    assert mail.newly_written(marked, plain) == "We moved the shelf."
    assert "Nobody counted" in mail.newly_written(strange_mails()[1], m)


def test_the_gain_decides(monkeypatch):
    m = mail.MailModel(strange_mails())
    texts = [t for t, _ in CASES if t] + strange_mails(12) + ["It reached you by mistake, said the clerk, and they delete it from your system."]
    found = [mail.foreign(t, m) for t in texts]
    monkeypatch.setattr(mail.MailModel, "suspected", lambda *a: False)
    assert not any(s.kind != "quoted" for t in texts for s in mail.foreign(t, m))
    monkeypatch.setattr(mail.MailModel, "suspected", lambda *a: True)
    monkeypatch.setattr(mail.MailModel, "overlap", lambda *a: 1.0)
    assert [mail.foreign(t, m) for t in texts] != found


def test_counts_over_a_table_equal_counts_over_texts(spark):
    texts = strange_mails()
    df = spark.createDataFrame([(t,) for t in [*texts, *texts[:50], None, ""]], "t string").repartition(5)
    a, b = mail.fit_mails(df, "t"), mail.MailModel(texts)
    assert a.openers == b.openers and a.lone == b.lone and all(a.of[k].lines == b.of[k].lines for k in mail.KINDS)


def words_of(i, n):
    """Words of no other number."""
    return ["".join(chr(97 + (i * 16 + k) // 26**d % 26) for d in range(4)) + "qx" for k in range(n)]


def many_closings_and_notices(n=450):
    """Each notice and each closing in three mails, together more than a page holds."""
    for i in range(n):
        a, b, c, d, *more = words_of(i, 16)
        notice = " ".join(more) + "."
        for k in range(3):
            new = f"The depot {a}{'xyz'[k]} got crates {b}{'xyz'[k]} before noon.\nNobody counted {c}{'xyz'[k]} twice."
            yield f"{new}\n\n{a} {b} groet,\n[REDACTED_PERSON]\n{c} {d}\n\nIf you have received this e-mail in error, please notify the sender and delete it. {notice}"


def asked(i):
    a, b, c, d, *more = words_of(i, 16)
    notice = " ".join(more)
    yield f"We moved the shelf.\n\n{a} {b} groet,\nJan de Vries\n{c} {d}\n\n{notice}.", {"signature", "disclaimer"}
    yield f"We moved the shelf. {a} {b} groet, Jan Vries {c} {d} T: [REDACTED_PHONE] {notice}.", {"signature", "disclaimer"}
    yield f"We moved the shelf.\n\n{a} the shelf {d} is here", set()


def test_no_line_is_left_out_of_a_dictionary():
    m = mail.MailModel(many_closings_and_notices())
    assert all(len(m.of[k].preset) <= mail.DICTIONARY_BYTES and m.of[k].behind for k in ("signature", "disclaimer"))
    for i in range(0, 450, 7):
        for text, want in asked(i):
            assert {s.kind for s in mail.foreign(text, m)} == want, text
            assert mail.newly_written(text, m) == (text if not want else "We moved the shelf.")


def test_lines_of_a_small_share_and_long_lines_count():
    long = " ".join(words_of(9_000, 16) * 60)  # no page and no window holds it
    rare = [f"{t.replace('depot', f'depot {word}')} {long}." for t, word in zip(many_closings_and_notices(1), ("one", "two", "three"))]
    m = mail.MailModel([*rare, *(" ".join(words_of(i, 3)) + "\n\nThe end" for i in range(10_000, 17_000))])
    assert {s.kind for s in mail.foreign(next(asked(0))[0], m)} == {"signature", "disclaimer"}
    assert mail.newly_written(f"We moved the shelf.\n\n{long}.", m) == "We moved the shelf."


def test_lines_that_reach_their_mails_by_a_join(spark, monkeypatch):
    mails = [*many_closings_and_notices(), *strange_mails()]
    m = mail.MailModel(mails)
    texts = [t for i in range(0, 450, 9) for t, _ in asked(i)] + mails[:300] + strange_mails(30) + [t for t, _ in CASES]
    monkeypatch.setattr(mail, "HELD_BYTES", 0)
    schema = "id string, redacted_text string"
    joined = mail.fit_mails(spark.createDataFrame([("", t) for t in mails], schema), "redacted_text")
    assert joined.behind is not None and all(joined.of[k].page == m.of[k].page and not joined.of[k].behind for k in mail.KINDS)
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], schema)
    got = {(r.id, r.foreign_part) for r in mail.parts(df, "id", "redacted_text", joined).collect()}
    assert got == {(str(i), s.kind) for i, t in enumerate(texts) for s in mail.foreign(t, m)}
    assert {r.id: r.new_text for r in mail.reduce(df, "id", "redacted_text", joined).collect()} == {str(i): mail.newly_written(t, m) for i, t in enumerate(texts)}
    assert mail.parts(df.limit(0), "id", "redacted_text", joined).count() == 0


def test_mail_table(spark):
    df = spark.createDataFrame([(str(i), t, "clash") for i, (t, _) in enumerate(CASES)] + [(None, CASES[4][0], "c"), ("4", CASES[4][0], "c")], "id string, redacted_text string, foreign_part string")
    m = mail.fit_mails(df, "redacted_text")
    got = mail.parts(df, "id", "redacted_text", m).groupBy("id", "foreign_part").count().collect()
    assert {(r.id, r.foreign_part) for r in got} == {(str(i), k) for i, (_, ks) in enumerate(CASES) for k in ks} | {(None, "signature")}
    assert mail.reduce(df, "id", "redacted_text", m).count() == df.count()
    assert mail.parts(df.limit(0), "id", "redacted_text", mail.fit_mails(df.limit(0), "redacted_text")).count() == 0


# --- privacy -------------------------------------------------------------------------------

KNOWN = [("Odran", "Holloby"), ("Søric", "Belquist"), ("Tamsyna", "Lacerne")]
MODEL = privacy.NameModel(KNOWN, ["From: Marvette Kirwick\nSent: now", "the notes are small words " * 3] * 8)
FOUND = [
    ("write a.b+c@mail.x.example now", "email"),
    ("write a_b [at] x [dot] example now", "email"),
    ("reach jo dot hall at mail dot x dot example soon", "email"),
    ("CC a.b＠x.example", "email"),
    ("Call +33 1 99 00 39 16 now", "phone"),
    ("call (416) 555-0144, or not", "phone"),
    ("call 4165550144.", "phone"),
    ("call 1-416-555-0139 ext. 42", "phone"),
    ("say four one six five five five zero one four four", "phone"),
    ("the SIN (046454286) is", "sin"),
    ("NAS 046 454 286 sur", "sin"),
    ("zero four six four five four two eight six as filed", "sin"),
    ("card 4111-1111-1111-1111 was", "cc"),
    ("card 3782 822463 10005 was", "cc"),
    ("host 10.1.2.255 is", "ip"),
    ("host 2001:db8::b71d is", "ip"),
    ("at 948 bis, rue des Saddlers, Grandlac today", "address"),
    ("at Suite 153, 42 Wickham Road, New Tarrant.", "address"),
    ("at 28 hollis road, grandlac", "address"),
    ("at twenty-seven Millrace Street in Upper Wend", "address"),
    ("Ferrystraße 3, 51693 New Tarrant", "address"),
    ("I met Odran Holloby there", "person"),
    ("I met HOLLOBY, Odran there", "person"),
    ("I met Odran-Søric Belquist there", "person"),
    ("ask odran holloby please", "person"),
    ("ask Odran H. please", "person"),
    ("ask O. Holloby please", "person"),
    ("mr. holloby said", "person"),
    ("Marvette Kirwick said", "person"),
]
NOT_FOUND = [
    "Batch 501-410-866 closed. Tracking 7529 8004 9388 4119 is stuck.",
    "The Tarn Street campaign starts in June.",
    "It ran from 11:33:07 until noon on 18/4/2025 11:27. Version 8.12.13 is out.",
    "Ping @channel about Invoice INV-2026-5243 of $5,005,860.12 at https://x.example/kb/9478123456",
    "[REDACTED_PERSON] of Osmere Logistics, [REDACTED_PHONE], IT Manager",
    "host 10.1.2.256 and 12:34:56",
    "",
    None,
]


def test_entities():
    for text, kind in FOUND:
        assert [e.kind for e in privacy.find(text, MODEL)] == [kind], text
    for text in NOT_FOUND:
        assert privacy.find(text, MODEL) == [], text
    assert privacy.redact("I met Odran Holloby at 10.1.2.3.", MODEL) == "I met [REDACTED_PERSON] at [REDACTED_IP]."
    assert privacy.redact(None, MODEL) is None
    long = "quiet words here. " * 200_000 + "mail a@b.example"
    assert [e.kind for e in privacy.find(long, MODEL)] == ["email"]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.sampled_from([t for t, _ in FOUND]), st.text(max_size=20)), max_size=6).map(" ".join))
def test_entities_are_apart_and_the_rest_is_kept(text):
    found = privacy.find(text, MODEL)
    assert all(a.end <= b.start for a, b in zip(found, found[1:]))
    red = privacy.redact(text, MODEL)
    at = 0
    for e in found:
        keep = text[at : e.start]
        assert red.startswith(keep + privacy.PLACEHOLDERS[e.kind])
        red = red[len(keep) + len(privacy.PLACEHOLDERS[e.kind]) :]
        at = e.end
    assert red == text[at:]


def test_surrogates(spark):
    rows = [("1", "Odran Holloby wrote to a.b@x.example; HOLLOBY, Odran called 416-555-0144."), ("2", "Ask Odran Holloby, card 4111-1111-1111-1111, +1 416 555 0144"), ("3", None), ("4", ""), (None, "Odran Holloby"), ("1", "Odran Holloby wrote to a.b@x.example; HOLLOBY, Odran called 416-555-0144.")]
    df = spark.createDataFrame(rows, "id string, t string")
    out = {r.id: r.text for r in privacy.with_surrogates(df, "id", "t", MODEL, b"key").collect()}
    assert set(out) == {"1", "2", "3", "4"} and out["3"] is None and out["4"] == ""
    assert "Holloby" not in out["1"] + out["2"]
    name = out["1"].split(" wrote")[0]
    given_name, family = name.split(" ")
    assert f"{family.upper()}, {given_name} called" in out["1"] and f"Ask {name}," in out["2"]
    card = re.search(r"card ([\d-]+)", out["2"])[1]
    assert card.count("-") == 3 and privacy.luhn(card.replace("-", "")) and card != "4111-1111-1111-1111"
    assert re.sub(r"\D", "", out["1"])[-10:] == re.sub(r"\D", "", out["2"])[-10:]
    assert privacy.with_surrogates(df.limit(0), "id", "t", MODEL, b"key").count() == 0


def made(kind, raw, key=b"key", given=("john", "susan", "henry", "odran", "søric")):
    ps = surrogates.take_apart(kind, raw, lambda w: w.lower() in given, privacy.spoken_digits)
    return surrogates.put_together(ps, {p: surrogates.part_surrogate(*p, key) for p in surrogates.parts_of(ps)}, key)


def test_surrogates_of_one_person_are_one_person():
    given, family = made("person", "John Smith").split()
    assert made("person", "Smith") == family and made("person", "Dr. Smith") == f"Dr. {family}" and made("person", "mr. smith") == f"mr. {family.lower()}"
    assert made("person", "J. Smith") == f"{given[0]}. {family}" and made("person", "John S.") == f"{given} {family[0]}." and made("person", "SMITH, John") == f"{family.upper()}, {given}"
    assert made("person", "John") == given and made("person", "John Smith", b"other") != f"{given} {family}"
    first = made("person", "Odran-Søric Belquist").split(" ")[0]
    assert first.split("-") == [made("person", "Odran"), made("person", "Søric")]


def test_surrogates_match_gender_and_script():
    g = surrogates.GENDER
    for name, female in (("Susan", True), ("Henry", False), ("Mary", True), ("George", False), ("Ingrid", True), ("Олена", True), ("Микола", False), ("Valentina", True), ("Rupertus", False)):
        assert g.is_female(name) == female, name
        assert g.is_female(surrogates.part_surrogate("given", name.lower(), b"k")) == female, name
    known = [(n, True) for n in surrogates.FEMALE] + [(n, False) for n in surrogates.MALE]
    hits = 0
    for k in range(0, len(known), 5):  # names held out of the fit
        rest = known[:k] + known[k + 5 :]
        m = surrogates.Gender([n for n, f in rest if f], [n for n, f in rest if not f])
        hits += sum(m.is_female(n) == f for n, f in known[k : k + 5])
    assert hits / len(known) > 0.65  # names of seven languages; a guess gives a half
    for name, script in (("Шевченко", "cyrillic"), ("Παπαδάκης", "greek"), ("田中", "han"), ("やまだ", "kana"), ("Smith", "latin")):
        new = surrogates.part_surrogate("family", name.lower(), b"k")
        assert {surrogates.script_of(c) for c in new} == {script}, new


def test_surrogates_of_numbers_keep_country_and_checks():
    assert re.fullmatch(r"\+49 3\d \d{7}", made("phone", "+49 30 1234567")) and re.fullmatch(r"\+44 \(0\)2\d \d{4} \d{4}", made("phone", "+44 (0)20 7946 0000"))
    same = {re.sub(r"\D", "", made("phone", x))[-10:] for x in ("(416) 555-1234", "+1 416 555 1234", "1-416-555-1234", "4165551234")}
    assert len(same) == 1
    for i in range(300):
        n = re.sub(r"\D", "", made("phone", f"416-555-{i:04d}"))
        assert n[0] in "23456789" and n[3] in "23456789" and n[4:6] != "11" and n[1:3] != "11"
        assert privacy.luhn(re.sub(r"\D", "", made("sin", f"{i:03d} 454 286"))) and privacy.luhn(re.sub(r"\D", "", made("cc", f"4111-1111-1111-{i:04d}")))
    spoken = made("phone", "four one six five five five one two three four")
    assert privacy.spoken_digits(spoken) == same.pop() and set(spoken.split()) <= set(surrogates.DIGITS_EN)
    assert set(made("phone", "quatre un six cinq cinq cinq un deux trois quatre").split()) <= set(surrogates.DIGITS_FR)
    assert made("ip", "10.1.2.3").startswith("10.") and made("ip", "192.168.1.9").startswith("192.168.") and made("ip", "2001:db8::b71d").startswith("2001:db8:")


def test_surrogates_of_addresses_keep_their_language():
    assert re.fullmatch(r"\w+straße \d, \d{5} \w+", made("address", "Hauptstraße 5, 10115 Berlin"))
    assert re.fullmatch(r"\d{3} bis, rue des \w+, \w+", made("address", "948 bis, rue des Saddlers, Grandlac"))
    road = made("address", "Suite 153, 42 Wickham Road, New Tarrant")
    assert re.fullmatch(r"Suite \d{3}, \d\d \w+ Road, \w+ \w+", road) and made("address", "42 Wickham Rd") == re.search(r"\d\d \w+ R", road)[0] + "d"
    assert len({made("address", f"{i} Wickham Road") for i in range(1, 10_000)}) == 9_999  # houses of a street stay apart
    assert "seven" not in made("address", "twenty-seven Millrace Street") and made("email", "a_b [at] x [dot] org").count(" [dot] ") == 1
    assert made("email", "jo.hall@x.com").split("@")[1] == made("email", "other@x.com").split("@")[1]


@settings(max_examples=150, deadline=None)
@given(st.sampled_from(["email", "phone", "sin", "cc", "address", "person"]), st.text(st.sampled_from("abXÉ .,-'@0123456789(+_я文"), min_size=1, max_size=24))
def test_pieces_give_the_mention_again(kind, raw):
    ps = surrogates.take_apart(kind, raw, lambda w: False, lambda t: "4165550144")
    assert "".join(p.shape or p.text for p in ps) == raw


def test_surrogates_stay_distinct_and_are_nobody_real(spark, monkeypatch):
    names = spark.range(30_000).selectExpr("'family' AS cls", "concat('s', conv(id + 46656, 10, 36)) AS part")  # more than short forms of one letter
    chosen = surrogates.assign(names.unionByName(names), b"k", few=0).collect()
    assert {tuple(r) for r in surrogates.assign(names, b"k").collect()} == {tuple(r) for r in chosen}  # in one task and by rounds
    s = [r.s for r in chosen]
    assert len(s) == 30_000 == len(set(s)) and len({x[0] for x in s}) == 1 and not set(s) & {r.part for r in chosen}
    taken = surrogates.part_surrogate("family", "smith", b"k")
    two = {r.part: r.s for r in surrogates.assign(spark.createDataFrame([("family", "smith"), ("family", taken), ("place", taken)], "cls string, part string"), b"k").collect()}
    assert two["smith"] != taken  # a real name of the corpus
    assert surrogates.assign(names.limit(0), b"k").count() == 0


def test_checks_before_a_pattern_are_no_narrower():
    for text, kind in [
        ("write name [ at ] host.com now", "email"),
        ("write name {at} host.com now", "email"),
        ("write jo at mail point example now", "email"),
        ("met Dr Quorvan Zellith there", "person"),
        ("say five five five five five five five five five five", "phone"),
        ("say un un un un un un un un un un", "phone"),
    ]:
        assert [e.kind for e in privacy.find(text, MODEL)] == [kind], text


def test_models_answer_for_themselves():
    import pickle

    text = "Later Quorvan Zellith agreed"
    assert privacy.find(text, privacy.NameModel([], [])) == []
    m = privacy.NameModel([("Quorvan", "Zellith")], [])
    assert [e.kind for e in privacy.find(text, m)] == ["person"]
    assert not pickle.loads(pickle.dumps(m)).no_names and m.no_names
    line = "zzyq vorn plexid uttram"
    plain, taught = mail.MailModel(), mail.MailModel([f"Kind regards,\n[REDACTED_PERSON]\n{line}"] * 3)
    assert not plain.suspected(line, "signature") and taught.suspected(line, "signature")
    assert not pickle.loads(pickle.dumps(taught)).suspicions


def test_privacy_table(spark):
    df = spark.createDataFrame([("a", FOUND[0][0], "clash"), ("a", FOUND[0][0], "clash"), ("b", None, "c"), (None, FOUND[0][0], "c")], "id string, t string, kind string")
    m = privacy.fit_names(df, "t", spark.createDataFrame(KNOWN, "given_name string, family_name string"))
    assert {tuple(r) for r in privacy.kinds(df, "id", "t", m, b"k").where("kind = 'email'").collect()} == {("a", "email"), (None, "email")}
    r = {x.id: x for x in privacy.redacted(df, "id", "t", m).collect()}
    assert r["b"].text is None and r["b"].log == [] and r["a"].log[0].offset == 6
    assert privacy.kinds(df.limit(0), "id", "t", privacy.fit_names(df.limit(0), "t", spark.createDataFrame([], "given_name string, family_name string")), b"k").count() == 0


def test_names_are_learned_from_all_texts(spark):
    letters = "bcdfghjklm"
    rare = [(f"Ora{a}{b}", f"Tib{b}{a}u") for a in letters[:5] for b in letters[:5]]  # each in one header of 40,000 texts
    rows = spark.range(40_000).selectExpr("concat('text ', id, IF(id % 100 = 0, ' plimt', ''), IF(id < 10, ' dronk', '')) AS t")
    df = rows.unionByName(spark.createDataFrame([(f"From: {g} {f}\nSent: now",) for g, f in rare] + [("text 7 dronk",)] * 50, "t string"))
    m = privacy.fit_names(df, "t", spark.createDataFrame(KNOWN, "given_name string, family_name string"))
    assert {g.lower() for g, _ in rare} <= m.given and {f.lower() for _, f in rare} <= m.family
    assert [e.kind for e in privacy.find(f"Later {rare[7][1]} agreed", m)] == ["person"]
    assert {"text", "plimt"} <= m.common and "dronk" not in m.common  # ten of 40,000 texts, and copies count once
    assert not {"orabb", "odran"} & m.common


# --- tokens --------------------------------------------------------------------------------


@settings(max_examples=120, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_encoding_equals_the_library(texts):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert bpe.encoder(bpe.vocabulary()).encode_all(texts) == want


def test_encoding_of_odd_texts():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    texts = ["<|endoftext|>", "aaaaaaaaaaaaaaaaaaaa", "x" * 50_000, " \n\t  ", "👩🏽‍💻 ﬁ", "ab" * 3000 + " ba" * 3000]
    assert bpe.encoder(bpe.vocabulary()).encode_all([*texts, "", None]) == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)] + [[], []]


def test_encoding_table(spark):
    df = spark.createDataFrame([(1, "a b", 0), (1, "a b", 0), (2, None, 0), (3, "", 0)], "doc_id long, text string, ids int")
    got = sorted((r.doc_id, r.ids) for r in bpe.encode(df, "text", "doc_id").collect())
    assert [k for k, _ in got] == [1, 1, 2, 3] and got[0] == got[1] and got[2][1] == got[3][1] == []
    assert bpe.encode(df.limit(0), "text", "doc_id").count() == 0
    assert [r.n_tokens for r in bpe.encode(df, "text", "doc_id", counts_only=True).orderBy("doc_id").collect()] == [2, 2, 0, 0]


# --- mixing --------------------------------------------------------------------------------

DOCS = "doc_id long, source string, n_tokens long, bucket int"
TARGETS = "mix_id string, source string, target_share double, max_repeats int, size_ratio double"


def test_water_fill():
    sizes = {"a": 100, "b": 100, "c": 1000}
    assert mixing.water_fill({"a": 1, "b": 1, "c": 2}, sizes, dict.fromkeys("abc"), 400) == {"a": 100, "b": 100, "c": 200}
    assert mixing.water_fill({"a": 1, "b": 1, "c": 2}, sizes, {"a": 1, "b": 2, "c": 9}, 800) == {"a": 100, "b": 200, "c": 500}
    assert mixing.water_fill({"a": 1, "b": 1}, sizes, {"a": 1, "b": 1}, 800) == {"a": 100, "b": 100}
    assert mixing.water_fill({"a": 0, "x": 1}, sizes, {"a": 1, "x": 1}, 800) == {"a": 0, "x": 0}


def test_mix(spark):
    rng = random.Random(2)
    docs = [(i, rng.choice("aaaaaabbc"), rng.randint(0, 300), 0) for i in range(3000)] + [(9000, None, 500, 0), (9001, "other", 500, 0), (9002, "a", None, 0), (None, "a", 10, 0)]
    targets = [("m", "a", 0.5, 1, 0.4), ("m", "b", 0.3, 2, 0.4), ("m", "c", 0.2, 3, 0.4), ("m", "none", 0.0, 1, 0.4), ("n", "c", 10.0, None, 1.5), ("n", "gone", 5.0, 2, 1.5), ("e", "gone", 1.0, 1, 1.0), (None, "a", 1.0, 1, 1.0), ("z", "a", None, -1, 0.5)]
    uses, shares = mixing.mix(spark.createDataFrame(docs, DOCS), spark.createDataFrame(targets, TARGETS), seed=3)
    s = {(r.mix_id, r.source): r for r in shares.collect()}
    total = sum(t or 0 for i, _, t, _ in docs if i is not None)
    for src, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert abs(s["m", src].actual_tokens - 0.4 * total * share) <= 150
        assert s["m", src].actual_share == pytest.approx(share, abs=0.002)
    assert abs(s["n", "c"].actual_tokens - 1.5 * total) <= 150 and s["n", "c"].actual_share == 1.0
    assert s["e", "gone"].actual_tokens == 0 and s["e", "gone"].actual_share is None and s["z", "a"].actual_tokens == 0
    u = uses.collect()
    assert len({(r.mix_id, r.doc_id) for r in u}) == len(u) and all(r.uses >= 1 for r in u)
    per = {}
    for r in u:
        per.setdefault((r.mix_id, r.source), []).append(r.uses)
    assert all(max(x) - min(x) <= 1 for x in per.values() if len(x) > 1 and min(x) > 1)
    assert max(per["m", "a"]) == 1
    again, _ = mixing.mix(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(targets, TARGETS), seed=3)
    assert {tuple(r) for r in again.select("mix_id", "doc_id", "uses").collect()} == {(r.mix_id, r.doc_id, r.uses) for r in u}
    none, sh = mixing.mix(spark.createDataFrame([], DOCS), spark.createDataFrame(targets, TARGETS))
    assert none.count() == 0 and sh.where("actual_tokens > 0").count() == 0


def test_hot_source_ends_exactly(spark):
    docs = spark.range(40_000).selectExpr("id AS doc_id", "'a' AS source", "1L AS n_tokens", "0 AS bucket")
    t = spark.createDataFrame([("m", "a", 1.0, 3, 1.25)], TARGETS)
    uses, _ = mixing.mix(docs, t)
    n = {r.uses: r["count"] for r in uses.groupBy("uses").count().collect()}
    assert n == {2: 10_000, 1: 30_000}


# --- look-alikes ---------------------------------------------------------------------------

SAME = [
    ("naïve file", "naïve ﬁle"), ("User 12", "Ｕｓｅｒ　１２"), ("the case", "thе саѕе"), ("non-breaking", "non‑breaking"), ("a b", "a b"), ("a b", "a b"),
    ("zero", "ze​ro﻿"), ("soft", "so­ft"), ("フォルダ", "ﾌｫﾙﾀﾞ"), ("line\nend", "line\r\nend"), ("ệ", "ệ"), ("ệ", "ệ"), ("Ångström", "Ångström"), ("TOP", "ΤΟΡ"),
    ("مرحبا", "مرحب\u200dا"), ("دا", "د\u200cا"),
]
DIFFERENT = [("User", "uSER"), ("a", "à"), ("1", "2"), ("a b", "ab"), ("a\nb", "a b"), ("x²", "x2"), ("don’t", "don't"), ("👩‍💻", "👩💻"), ("a-b", "a–b"), ("a.", "a"), ("к", "k"), ("بب", "ب\u200cب")]


def test_forms():
    f = lookalikes.canonical_form
    for a, b in SAME:
        assert f(a) == f(b), (a, b)
    for a, b in DIFFERENT:
        assert f(a) != f(b), (a, b)
    assert f(None) is None and f("") == ""
    long = "plain text " * 200_000
    assert f(long) == long and f(long + "ﬁ") == long + "fi"


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aeọ́̈ éﬁ​­аеοΑ Ａｂ\r\nｶﾞ-‐가가👩‍💻"), max_size=24))
def test_a_form_is_its_own_form(text):
    form = lookalikes.canonical_form(text)
    assert lookalikes.canonical_form(form) == form
    assert unicodedata.is_normalized("NFC", form)
    assert lookalikes.canonical_form(unicodedata.normalize("NFD", text)) == lookalikes.canonical_form(unicodedata.normalize("NFC", text))


MORE_SAME = [("o", "\u0585"), ("A", "\u13aa"), ("H", "\U0001d407"), ("IV", "\u2163"), ("a", "\u0251"), ("a b", "a\ufe0f b"), ("ab", "a\U000e0041b"), ("\u212b", "A\u030a"), ("\uac00", "\u1100\u1161"), ("q\u0307\u0323", "q\u0323\u0307"), ("e\u0301", "e\u200b\u0301")]
MORE_DIFFERENT = [("\u2764", "\u2764\ufe0f"), ("1\ufe0f\u20e3", "1\u20e3"), ("\U0001f3f4", "\U0001f3f4\U000e0067\U000e0062\U000e007f"), ("\u845b", "\u845b\ufe00"), ("\u2460", "1"), ("\u00bd", "1/2")]


def test_more_forms():
    f = lookalikes.canonical_form
    for a, b in MORE_SAME:
        assert f(a) == f(b), (a, b)
    for a, b in MORE_DIFFERENT:
        assert f(a) != f(b), (a, b)


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.characters(categories=["Mn", "Mc", "Cf"]), st.sampled_from("\u1100\u1161\u11a8\uac00\u0344\u0340\u0585\U0001d407\ufe0f")), max_size=12))
def test_no_unstable_segment_is_missed(text):
    form = lookalikes.canonical_form(text)
    assert lookalikes.canonical_form(form) == form and unicodedata.is_normalized("NFC", form)
    assert lookalikes.canonical_form(unicodedata.normalize("NFD", text)) == lookalikes.canonical_form(unicodedata.normalize("NFC", text))
    # Normalizing the whole text finds nothing more.
    assert unicodedata.normalize("NFC", form.translate(lookalikes.properties().table)) == form


def test_groups_and_blocks(spark):
    rows = [(i, ["naïve", "nai\u0308ve", "na\u200bïve"][min(i % 5, 2)], "x") for i in range(60)] + [(100 + i, "copy", "x") for i in range(50)] + [(None, "naïve", "x"), (200, "\u200b", "x"), (201, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string")
    g = lookalikes.lookalike_groups(df, "doc_id", "text").collect()
    assert sorted(r.doc_id for r in g) == list(range(60)) and {r.first_of_form for r in g} == {0} and {r.n for r in g} == {60}
    assert {r.first_of_writing for r in g} == {0, 1, 2} and len({r.form for r in g}) == 1
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if rows[a][1] != rows[b][1]}
    for block in (7, 4_000):
        got = [tuple(r) for r in lookalikes.lookalike_pairs(df, "doc_id", "text", block).collect()]
        assert len(got) == len(want) and set(got) == want
    assert lookalikes.lookalike_groups(df.limit(0), "doc_id", "text").count() == 0 == lookalikes.lookalike_pairs(df.limit(0), "doc_id", "text").count()


def test_pairs_against_brute_force(spark):
    rng = random.Random(3)
    texts = [t for p in SAME + DIFFERENT for t in p] + [None, "", " ", "​", "copy", "copy", "copy"]
    rows = [(i, rng.choice(texts), "x") for i in range(120)] + [(None, "a b", "x"), (0, "a b", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, f string")
    got = sorted((r.a, r.b) for r in lookalikes.lookalike_pairs(df, "doc_id", "text").collect())
    want = set()
    for i, s, _ in rows:
        for j, t, _ in rows:
            if i is not None and j is not None and i < j and s and t and s != t and lookalikes.canonical_form(s).strip("​ ") and lookalikes.canonical_form(s) == lookalikes.canonical_form(t):
                want.add((i, j))
    assert got == sorted(want) and want
    assert lookalikes.lookalike_pairs(df.limit(0), "doc_id", "text").count() == 0
    assert lookalikes.canonical(df, "doc_id", "text").count() == len(rows)


def test_batches_by_bytes():
    import pyarrow as pa

    from loomstone.llm.common import by_bytes

    b = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["x" * 10, None, "y" * 95, "é" * 60, "", "z"])], ["k", "t"])
    parts = list(by_bytes(b, 1, 100))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([b])) and [p.num_rows for p in parts] == [2, 1, 1, 2]
    assert list(by_bytes(b.slice(0, 0), 1)) == []
