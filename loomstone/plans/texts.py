"""Text, date, array and JSON functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.functions import arrays as A
from loomstone.functions import dates as D
from loomstone.functions import pii
from loomstone.functions import text as X
from loomstone.operators import chunking, redaction
from loomstone.operators import sessions as S
from loomstone.plans.common import Catalog, Tables, now_of

catalog = Catalog()
query = catalog.query

SP = r"[\t\n\x0b\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def sq(c: str) -> str:
    return f"trim(regexp_replace({c}, '{SP}+', ' ', 'g'), ' ')"


def ws(c: str) -> str:
    return f"list_filter(string_split({sq(c)}, ' '), lambda w: w <> '')"


STRIPPED = "text"
for _pattern, _with in ((r"(?is)<(?:script\b[^>]*>.*?</script|style\b[^>]*>.*?</style)\s*>", " "), (r"<[^>]*>", " ")):
    STRIPPED = f"regexp_replace({STRIPPED}, '{_pattern}', '{_with}', 'g')"
for _a, _b in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''")):
    STRIPPED = f"replace({STRIPPED}, '{_a}', '{_b}')"


@query(f"SELECT doc_id, {sq(STRIPPED)} AS text FROM documents")
def html_to_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.strip_html(F.col("text")).alias("text"))


@query(f"""SELECT doc_id, len({ws('text')}) AS n_words, length(regexp_replace(text, '[^0-9]', '', 'g')) AS n_digits, substr({sq('text')}, 1, 80) AS head,
                  array_to_string(list_slice({ws('text')}, 1, 10), ' ') || CASE WHEN len({ws('text')}) > 10 THEN '…' ELSE '' END AS first_words,
                  sha256(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS escaped
           FROM documents WHERE text IS NOT NULL""")
def text_measures(t: Tables) -> DataFrame:
    c = F.col("text")
    return t.documents.where("text is not null").select(
        "doc_id",
        X.word_count(c).cast("long").alias("n_words"),
        X.digit_count(c).cast("long").alias("n_digits"),
        X.clamp(c).alias("head"),
        X.first_words(c, 10).alias("first_words"),
        F.sha2(X.escape_html(c), 256).alias("escaped"),
    )


# Written out here once more, so that the SQL does not follow the engine's list.
_COMMON = """['because', 'through', 'however', 'therefore', 'although', 'business', 'businesses', 'company', 'companies', 'customer', 'customers', 'service', 'services', 'solution', 'solutions', 'important', 'different', 'something', 'everything', 'available', 'technology', 'organization', 'management']"""
DISTINCTIVE = (
    "list_distinct(list_transform(list_filter(regexp_extract_all({c}, '[A-Za-z0-9]+'), lambda w: (regexp_matches(w, '[0-9]') AND length(w) >= 3) OR regexp_matches(w, '^[A-Z]{{3,}}$')"
    " OR (regexp_matches(w, '^[A-Za-z]{{7,}}$') AND NOT list_contains(" + _COMMON + ", lower(w)))), lambda w: lower(w)))"
)


@query(f"SELECT doc_id, array_to_string(list_sort({DISTINCTIVE.format(c='text')}), ' ') AS tokens FROM documents WHERE text IS NOT NULL")
def distinctive_tokens(t: Tables) -> DataFrame:
    return t.documents.where("text is not null").select("doc_id", F.array_join(F.array_sort(X.distinctive_tokens(F.col("text"))), " ").alias("tokens"))


@query(f"""WITH s AS (SELECT DISTINCT id, redacted_text FROM capture_signals WHERE id IS NOT NULL),
           c AS (SELECT id AS candidate_id, unnest(evidence_chunk_ids) AS sid, lower(proposed_title || ' ' || primary_keyword) AS title FROM
                   (SELECT id, any_value(evidence_chunk_ids) AS evidence_chunk_ids, min(proposed_title) AS proposed_title, min(primary_keyword) AS primary_keyword FROM article_candidates WHERE id IS NOT NULL GROUP BY id)),
           d AS (SELECT DISTINCT candidate_id, sid, title FROM c)
           SELECT candidate_id, count(*) AS n_evidence, count(*) FILTER (list_has_any({DISTINCTIVE.format(c='redacted_text')}, regexp_extract_all(title, '[a-z0-9]+'))) AS n_citing
           FROM d JOIN s ON s.id = d.sid GROUP BY 1""")
def corpus_citations(t: Tables) -> DataFrame:
    """How many evidence texts of a candidate share a distinctive token with its title and keyword. Only
    evidence texts move, and of them only their tokens."""
    c = t.article_candidates.where("id is not null").groupBy("id").agg(F.max("evidence_chunk_ids").alias("e"), F.min("proposed_title").alias("p"), F.min("primary_keyword").alias("k"))
    d = c.select(F.col("id").alias("candidate_id"), F.explode("e").alias("id"), F.lower(F.concat("p", F.lit(" "), "k")).alias("title")).distinct()
    s = t.capture_signals.join(d.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.max("redacted_text").alias("x")).select("id", X.distinctive_tokens(F.col("x")).alias("tokens"))
    hit = F.arrays_overlap("tokens", X.alphanumeric_tokens(F.col("title")))
    return d.join(s, "id").groupBy("candidate_id").agg(F.count(F.lit(1)).alias("n_evidence"), F.count_if(hit).alias("n_citing"))


PHRASES = ["half of the devices", "nobody could say", "by the way", "kept timing out", "the renewal is due"]


@query(f"""WITH p AS (SELECT doc_id, unnest({PHRASES!r}) AS phrase, lower(text) AS low FROM documents WHERE text IS NOT NULL),
           h AS (SELECT doc_id, phrase, instr(low, phrase) AS pos FROM p WHERE contains(low, phrase)),
           r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos, length(phrase) DESC, phrase) AS rn FROM h)
           SELECT doc_id, CAST(pos AS INTEGER) AS pos, phrase FROM r WHERE rn = 1""")
def earliest_phrase(t: Tables) -> DataFrame:
    x = t.documents.select("doc_id", X.earliest_phrase(F.col("text"), PHRASES).alias("m")).where("m is not null")
    return x.select("doc_id", "m.pos", "m.phrase")


EMAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}"


@query(f"SELECT DISTINCT id, len(regexp_extract_all(redacted_text, '{EMAIL}')) AS n_emails, regexp_replace(redacted_text, '{EMAIL}', '[REDACTED_EMAIL]', 'g') AS text FROM capture_signals WHERE regexp_matches(redacted_text, '{EMAIL}')")
def pii_emails(t: Tables) -> DataFrame:
    c = F.col("redacted_text")
    s = t.capture_signals.where(F.contains(c, F.lit("@")) & c.rlike(EMAIL))
    return s.select("id", F.regexp_count(c, F.lit(EMAIL)).cast("long").alias("n_emails"), F.regexp_replace(c, EMAIL, "[REDACTED_EMAIL]").alias("text")).distinct()


@query()
def pii_redacted(t: Tables) -> DataFrame:
    """The whole pattern pass; its look-arounds have no SQL, tests hold it against a plain version."""
    x = t.documents.select("doc_id", pii.regex_pass(F.col("text")).alias("r"))
    return x.select("doc_id", "r.status", "r.text", "r.log")


@query()
def pii_counts_by_type(t: Tables) -> DataFrame:
    x = t.capture_signals.select("id", F.explode(pii.types_found(F.col("redacted_text"))).alias("type"))
    return x.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("n_signals"))


CARD = "[0-9](?:[ -]?[0-9]){12,18}"


@query(f"""WITH m AS (SELECT id, unnest(list_transform(regexp_extract_all(redacted_text, '{CARD}'), lambda x: reverse(regexp_replace(x, '[^0-9]', '', 'g')))) AS digits FROM capture_signals),
           l AS (SELECT id, list_sum(list_transform(range(1, length(digits) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(digits[i] AS INTEGER)
                   ELSE CAST(digits[i] AS INTEGER) * 2 - CASE WHEN CAST(digits[i] AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0 AS ok FROM m)
           SELECT id, count(*) AS n_shaped, count(*) FILTER (ok) AS n_valid FROM l GROUP BY 1""")
def luhn_cards(t: Tables) -> DataFrame:
    x = t.capture_signals.select("id", F.explode(F.regexp_extract_all("redacted_text", F.lit(CARD), F.lit(0))).alias("m"))
    return x.groupBy("id").agg(F.count(F.lit(1)).alias("n_shaped"), F.count_if(pii.luhn_ok(F.col("m"))).alias("n_valid"))


HASHED = ["acct-001", "acct-002"]
KEYWORDS = ["unsubscribe", "password vault"]


@query(f"""SELECT doc_id, CASE WHEN list_contains(list_transform({HASHED!r}, lambda x: sha256(x)), sha256(lower(trim(account)))) THEN 'sender'
                 WHEN regexp_matches(split_part(text, chr(10), 1), '(?i)\\brisk register\\b') THEN 'subject'
                 WHEN contains(lower(text), 'unsubscribe') OR contains(lower(text), 'password vault') THEN 'keyword' END AS reason
           FROM documents WHERE text IS NOT NULL""")
def blocklist_filter(t: Tables) -> DataFrame:
    import hashlib

    hashes = [hashlib.sha256(x.encode()).hexdigest() for x in HASHED]
    first = F.element_at(F.split("text", "\n"), 1)
    reason = redaction.block_reason(F.col("account"), F.array().cast("array<string>"), first, F.col("text"), hashes, r"\brisk register\b", KEYWORDS)
    return t.documents.where("text is not null").select("doc_id", reason.alias("reason"))


@query("""SELECT session_id, uuid, CASE replace(replace(lower(trim(kind)), '-', '_'), ' ', '_') WHEN 'user_text' THEN 'USER: ' || text WHEN 'assistant_text' THEN 'ASSISTANT: ' || text
                 WHEN 'tool_call' THEN 'TOOL[' || tool || ']: ' || summary END AS line
          FROM session_events WHERE uuid IS NOT NULL AND ((replace(replace(lower(trim(kind)), '-', '_'), ' ', '_') IN ('user_text', 'assistant_text') AND text IS NOT NULL)
            OR (replace(replace(lower(trim(kind)), '-', '_'), ' ', '_') = 'tool_call' AND summary <> '' AND tool IS NOT NULL))""")
def transcript_lines(t: Tables) -> DataFrame:
    kind = F.regexp_replace(F.lower(F.trim("kind")), "[- ]", "_")
    line = S.transcript_line(kind, F.col("text"), F.col("tool"), F.col("summary"))
    return t.session_events.where("uuid is not null").select("session_id", "uuid", line.alias("line")).where("line is not null")


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, substr(props, 1, 80) AS head FROM events""")
def json_extract_clamp(t: Tables) -> DataFrame:
    return t.events.select("event_id", A.json_string(F.col("props"), "$.k").cast("int").alias("k"), X.clamp(F.col("props")).alias("head"))


@query("""SELECT vec_id, len(embedding) AS dim, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total FROM embeddings""")
def vector_round_trip(t: Tables) -> DataFrame:
    back = A.vector_of(A.vector_text(F.col("embedding")))
    total = F.aggregate(back, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return t.embeddings.select("vec_id", F.size(back).cast("long").alias("dim"), F.round(total, 6).alias("total"))


@query("""SELECT id, 'x:' || source_id || ':chunk-' || lpad(CAST(n AS VARCHAR), 4, '0') AS chunk_id, primary_kw FROM
            (SELECT DISTINCT id, source_id, CAST(split_part(source_id, ':', 2) AS INTEGER) AS n, lower(coalesce(topic_tags[1], source)) AS primary_kw FROM capture_signals WHERE source_id IS NOT NULL AND contains(source_id, ':'))""")
def chunk_source_ids(t: Tables) -> DataFrame:
    s = t.capture_signals.where(F.contains("source_id", F.lit(":")))
    n = F.split("source_id", ":")[1].cast("int")
    return s.select("id", X.chunk_source_id(F.lit("x"), F.col("source_id"), n).alias("chunk_id"), X.primary_keyword(F.col("topic_tags"), F.col("source")).alias("primary_kw")).distinct()


@query("""SELECT id, array_to_string(list_filter(list_transform(string_split(lower(cluster_label), ' '), lambda w: trim(w)), lambda w: w <> ''), ' ') AS words,
                 coalesce(nullif(substr(trim(regexp_replace(trim(cluster_label), '^["''“”]+|["''“”]+$', '', 'g')), 1, 80), ''), 'untitled') AS title FROM synthesis_clusters WHERE cluster_label IS NOT NULL""")
def cluster_titles(t: Tables) -> DataFrame:
    c = t.synthesis_clusters.where("cluster_label is not null")
    w = F.filter(F.transform(F.split(F.lower("cluster_label"), " "), F.trim), lambda x: x != "")
    return c.select("id", F.array_join(w, " ").alias("words"), X.clean_title(F.col("cluster_label"), F.lit("untitled")).alias("title"))


@query("""WITH RECURSIVE p AS (SELECT row_number() OVER () AS rn, id, created_at, list_filter(list_transform(answers, lambda a: trim(coalesce(a.transcript, a.text, ''), ' ')), lambda x: x <> '') AS parts FROM interview_sessions WHERE answers IS NOT NULL),
          f AS (SELECT rn, 0 AS i, CAST([] AS VARCHAR[]) AS kept, 0 AS used, 0 AS omitted FROM p
                UNION ALL SELECT f.rn, i + 1, CASE WHEN used + length(parts[i + 1]) <= 500 THEN list_append(kept, parts[i + 1]) ELSE kept END,
                                 used + CASE WHEN used + length(parts[i + 1]) <= 500 THEN CAST(length(parts[i + 1]) AS INTEGER) ELSE 0 END, omitted + CASE WHEN used + length(parts[i + 1]) <= 500 THEN 0 ELSE 1 END
                          FROM f JOIN p USING (rn) WHERE i < len(parts))
          SELECT id, created_at, array_to_string(kept, chr(10)) AS text, used, omitted FROM f JOIN p USING (rn) WHERE i = len(parts)""")
def greedy_insights(t: Tables) -> DataFrame:
    """Transcripts of a session packed into 500 characters, larger ones skipped for later, smaller ones."""
    s = t.interview_sessions.where("answers is not null")
    texts = F.transform("answers", lambda a: F.coalesce(a["transcript"], a["text"], F.lit("")))
    return s.select("id", "created_at", A.greedy_fill(texts, 500).alias("f")).select("id", "created_at", F.array_join("f.kept", "\n").alias("text"), "f.used", "f.omitted")


@query(f"""SELECT id, created_at, CAST(coalesce(list_sum(list_transform(answers, lambda a: len({ws("coalesce(a.transcript, a.text, '')")}))), 0) AS BIGINT) AS n_words FROM interview_sessions WHERE answers IS NOT NULL""")
def transcribed_words(t: Tables) -> DataFrame:
    n = F.aggregate(F.transform("answers", lambda a: X.word_count(F.coalesce(a["transcript"], a["text"], F.lit("")))), F.lit(0), lambda s, x: s + x)
    return t.interview_sessions.where("answers is not null").select("id", "created_at", n.cast("long").alias("n_words"))


@query()
def token_chunks(t: Tables) -> DataFrame:
    return chunking.chunks(t.documents, "doc_id", "text")


@query("""SELECT o_orderkey, CAST(CASE WHEN isodow(o_orderdate) = 1 THEN date_trunc('day', o_orderdate) ELSE date_trunc('week', o_orderdate) + INTERVAL 7 DAY END AS DATE) AS surfaced_for_week,
                 strftime(o_orderdate, '%A') AS day, strftime(o_orderdate, '%-I:%M %p UTC') AS clock, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%gZ') AS iso FROM orders""")
def order_dates(t: Tables) -> DataFrame:
    d = F.col("o_orderdate")
    return t.orders.select("o_orderkey", D.next_monday(d).alias("surfaced_for_week"), D.day_name(d).alias("day"), D.clock_utc(d).alias("clock"), D.iso_millis(d).alias("iso"))


@query("""WITH l AS (SELECT DISTINCT id, timezone('America/New_York', captured_at) AS lt FROM capture_signals WHERE captured_at IS NOT NULL),
          m AS (SELECT id, lt, CASE WHEN isodow(lt) = 1 AND hour(lt) < 8 THEN date_trunc('day', lt) ELSE date_trunc('week', lt) + INTERVAL 7 DAY END AS d FROM l)
          SELECT id, lt AS local_time, timezone('America/New_York', CAST(d AS TIMESTAMP) + INTERVAL 8 HOUR) AS due FROM m""")
def next_monday_8am_et(t: Tables) -> DataFrame:
    s = t.capture_signals.where("captured_at is not null").select("id", "captured_at").distinct()
    return s.select("id", F.from_utc_timestamp("captured_at", "America/New_York").cast("timestamp_ntz").alias("local_time"), D.next_monday_8am(F.col("captured_at")).alias("due"))


@query("""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)
          SELECT o_orderkey, (SELECT max(x) FROM (SELECT CAST(d + CAST(i AS INTEGER) AS DATE) AS x FROM (SELECT unnest(range(1, 15)) AS i) WHERE isodow(d + CAST(i AS INTEGER)) < 6 ORDER BY x LIMIT 4)) AS due FROM o""")
def business_days(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", D.add_business_days(F.col("o_orderdate"), 4).alias("due"))


@query("""SELECT DISTINCT id, captured_at, round((epoch_us((SELECT max(captured_at) FROM capture_signals)) - epoch_us(captured_at)) / 86400000000.0, 6) AS age_days,
                 CASE WHEN token_count > 0 THEN CAST(greatest(1, floor(token_count * 8 / 1000.0 + 0.5)) AS INTEGER) ELSE 1 END AS minutes FROM capture_signals WHERE captured_at IS NOT NULL""")
def signal_ages(t: Tables) -> DataFrame:
    s = t.capture_signals
    now = now_of(s, "captured_at")
    return s.where("captured_at is not null").select("id", "captured_at", F.round(D.age_days(now, F.col("captured_at")), 6).alias("age_days"), D.minutes_to_read(F.col("token_count")).alias("minutes")).distinct()
