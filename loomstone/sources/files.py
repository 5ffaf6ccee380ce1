"""Scans of session files: import folders, JSON documents, JSONL transcripts, and the JSON sink."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.functions import dates as D
from loomstone.functions import text as X

SCHEMA_VERSION = 1
EVENT_KINDS = ["user_text", "assistant_text", "tool_call", "subagent"]
# The keys of a session document, the required ones first.
REQUIRED_KEYS = ["schemaVersion", "_exporter", "source", "sessionId", "createdAt", "events"]
OPTIONAL_KEYS = ["sessionSlug", "continuationGroupId", "workspaceId", "title", "lastActivityAt", "model", "account", "cwds", "gitBranches", "mcpServers"]
EVENT_KEYS = {
    "user_text": ["kind", "ts", "uuid", "cwd", "gitBranch", "text"],
    "assistant_text": ["kind", "ts", "uuid", "cwd", "gitBranch", "text"],
    "tool_call": ["kind", "ts", "uuid", "cwd", "gitBranch", "tool", "summary"],
    "subagent": ["kind", "ts", "uuid", "cwd", "gitBranch", "subagentSlug", "parentToolUseId", "events"],
}


def discover(spark: SparkSession, folder: str, since: Column | None = None) -> DataFrame:
    """``(path, modified_at, length)`` of the importable files of a folder, by time and then path: ``.json``
    in any case, not hidden, no audit and no unfinished file; ``since`` itself counts. Any file system Spark
    reads will do; Spark itself never lists names that begin with ``.`` or ``_``. A folder without such files gives an empty
    table, a missing one is an error."""
    files = spark.read.format("binaryFile").load(folder).select("path", F.col("modificationTime").alias("modified_at"), "length")
    leaf = F.element_at(F.split("path", "/"), -1)
    files = files.where(F.lower(leaf).endswith(".json") & ~leaf.startswith(".") & ~leaf.startswith("_audit-") & ~leaf.contains(".tmp-"))
    if since is not None:
        files = files.where(F.col("modified_at") >= since)
    return files.orderBy("modified_at", "path")


def documents(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """``(path, doc, error_kind, issues)``: whole files as JSON texts, judged. ``error_kind`` is ``json``,
    ``version`` or ``schema``, null for a good document; at most five issues are kept."""
    raw = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("doc"))
    return judged(raw)


def judged(raw: DataFrame) -> DataFrame:
    """``raw (path, doc)`` with ``error_kind`` and ``issues`` beside it; strict: unknown keys are errors."""
    keys = F.json_object_keys("doc")
    version = F.get_json_object("doc", "$.schemaVersion")
    known = F.array(*[F.lit(k) for k in REQUIRED_KEYS + OPTIONAL_KEYS])
    required = F.array(*[F.lit(k) for k in REQUIRED_KEYS])
    missing = F.transform(F.array_except(required, keys), lambda k: F.concat(k, F.lit(": missing")))
    unknown = F.transform(F.array_except(keys, known), lambda k: F.concat(k, F.lit(": unknown key")))
    bad_time = F.filter(
        F.transform(F.array(F.lit("createdAt"), F.lit("lastActivityAt")), lambda k: F.when(k == "createdAt", _bad_time("createdAt")).otherwise(_bad_time("lastActivityAt"))),
        lambda x: x.isNotNull(),
    )
    events = F.from_json(F.get_json_object("doc", "$.events"), "array<string>")
    bad_events = event_issues(events, F.lit("events"))
    issues = F.slice(F.concat(missing, unknown, bad_time, F.coalesce(bad_events, F.array(F.lit("events: not an array")))), 1, 5)
    kind = F.when(keys.isNull(), "json").when(version.isNull() | (version != str(SCHEMA_VERSION)), "version").when(F.size(issues) > 0, "schema")
    return raw.withColumn("error_kind", kind).withColumn("issues", F.when(kind == "schema", issues).otherwise(F.array().cast("array<string>")))


def event_issues(events: Column, at: Column, levels: int = 3) -> Column:
    """What is wrong with the events of a JSON array, and with those inside subagent events, ``levels`` deep;
    deeper ones are judged when they are flattened. Of an inner array that is none one issue is told."""
    own = F.filter(F.transform(events, lambda e, i: event_issue(e, i, at)), lambda x: x.isNotNull())
    if not levels:
        return own

    def inner(e: Column, i: Column) -> Column:
        text = F.get_json_object(e, "$.events")
        below = F.from_json(text, "array<string>")
        name = F.concat(at, F.lit("."), i.cast("string"), F.lit(".events"))
        none = F.array().cast("array<string>")
        return F.when(F.get_json_object(e, "$.kind") != "subagent", none).when(below.isNull(), F.array(F.concat(name, F.lit(": not an array")))).otherwise(F.coalesce(event_issues(below, name, levels - 1), none))

    return F.concat(own, F.flatten(F.transform(events, lambda e, i: F.coalesce(inner(e, i), F.array().cast("array<string>")))))


def _bad_time(key: str) -> Column:
    v = F.get_json_object("doc", f"$.{key}")
    return F.when(v.isNotNull() & ~D.is_iso_millis(v), F.lit(f"{key}: not an ISO time with milliseconds"))


def event_issue(e: Column, i: Column, above: Column) -> Column:
    """What is wrong with one event's JSON, null if nothing is."""
    kind = F.get_json_object(e, "$.kind")
    at = F.concat(above, F.lit("."), i.cast("string"))
    out = F.when(~F.coalesce(kind.isin(EVENT_KINDS), F.lit(False)), F.concat(at, F.lit(".kind: unknown")))
    for k, allowed in EVENT_KEYS.items():
        extra = F.size(F.array_except(F.json_object_keys(e), F.array(*[F.lit(x) for x in allowed]))) > 0
        out = out.when((kind == k) & extra, F.concat(at, F.lit(": unknown key")))
    text = F.get_json_object(e, "$.text")
    return (
        out.when(~F.coalesce(D.is_iso_millis(F.get_json_object(e, "$.ts")), F.lit(False)), F.concat(at, F.lit(".ts: not an ISO time with milliseconds")))
        .when(kind.isin("user_text", "assistant_text") & (F.coalesce(text, F.lit("")) == ""), F.concat(at, F.lit(".text: empty")))
        .when((kind == "tool_call") & (F.coalesce(F.get_json_object(e, "$.tool"), F.lit("")) == ""), F.concat(at, F.lit(".tool: empty")))
        .when((kind == "tool_call") & (F.length(F.get_json_object(e, "$.summary")) > 80), F.concat(at, F.lit(".summary: longer than 80")))
    )


FLAT = "session_id string, path array<int>, depth int, kind string, ts timestamp, uuid string, cwd string, git_branch string, text string, tool string, summary string, subagent_slug string, parent_tool_use_id string"


EVENT_JSON = "kind string, ts string, uuid string, cwd string, gitBranch string, text string, tool string, summary string, subagentSlug string, parentToolUseId string, events string"


def flat_events(docs: DataFrame, max_depth: int = 16) -> DataFrame:
    """Event rows of good documents, nested ones with their path: level by level, as deep as the data goes.

    Deeper than ``max_depth`` is an error rather than a loss.
    """
    level = docs.where("error_kind is null").select(F.get_json_object("doc", "$.sessionId").alias("session_id"), F.array().cast("array<int>").alias("up"), F.get_json_object("doc", "$.events").alias("events"))
    out = None
    for depth in range(max_depth + 1):
        e = level.select("session_id", "up", F.posexplode(F.from_json("events", "array<string>")).alias("i", "e"))
        e = e.withColumn("path", F.concat("up", F.array("i")))
        e = e.withColumn("x", F.from_json("e", EVENT_JSON))  # once an event and level
        rows = e.select(
            "session_id", "path", F.lit(depth).alias("depth"), "x.kind", F.try_to_timestamp("x.ts").alias("ts"), "x.uuid", "x.cwd", F.col("x.gitBranch").alias("git_branch"),
            "x.text", "x.tool", "x.summary", F.col("x.subagentSlug").alias("subagent_slug"), F.col("x.parentToolUseId").alias("parent_tool_use_id"),
        )
        out = rows if out is None else out.unionByName(rows)
        level = e.where("x.events is not null").select("session_id", F.col("path").alias("up"), F.col("x.events").alias("events"))
        if level.limit(1).count() == 0:
            return out
    raise ValueError(f"events nested deeper than {max_depth}")


def transcript_lines(spark: SparkSession, paths: list[str] | str, max_bad: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """Lines of JSONL transcripts, and per file ``(path, lines_read, lines_failed, abandoned)``.

    Empty lines do not count; a file with more than ``max_bad`` bad lines is abandoned whole.
    """
    return parsed_lines(spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), "value"), max_bad)


def parsed_lines(raw: DataFrame, max_bad: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """The same of lines ``(path, value)`` that were read before."""
    raw = raw.where(F.length(F.trim("value")) > 0)
    lines = raw.withColumn("bad", F.json_object_keys("value").isNull())
    files = lines.groupBy("path").agg(F.count(F.lit(1)).alias("lines_read"), F.count_if("bad").alias("lines_failed"))
    files = files.withColumn("abandoned", F.col("lines_failed") / F.col("lines_read") > max_bad)
    g = lambda p: F.get_json_object("value", p)
    good = lines.where(~F.col("bad")).join(files.where(~F.col("abandoned")).select("path"), "path", "left_semi")
    content = g("$.message.content")
    block = "array<struct<type string, text string, name string, id string, input string>>"
    parsed = good.select(
        "path",
        g("$.type").alias("type"),
        g("$.timestamp").alias("timestamp"),
        g("$.uuid").alias("uuid"),
        F.coalesce(g("$.isMeta").cast("boolean"), F.lit(False)).alias("isMeta"),
        g("$.cwd").alias("cwd"),
        g("$.gitBranch").alias("gitBranch"),
        F.when(content.startswith("["), F.from_json(content, block)).alias("blocks"),
        F.when(~content.startswith("["), content).alias("content"),
    )
    return parsed, files


def session_meta(df: DataFrame, payload: str) -> DataFrame:
    """Typed fields of a session's side file (a JSON column); times as milliseconds or ISO text."""
    g = lambda k: F.nullif(F.get_json_object(payload, f"$.{k}"), F.lit(""))
    servers = F.from_json(F.get_json_object(payload, "$.mcpServers"), "array<struct<name string>>")
    return df.select(
        "*",
        *[g(k).alias(n) for k, n in (("sessionId", "session_id"), ("title", "title"), ("emailAddress", "email"), ("accountName", "account"), ("cwd", "cwd"), ("model", "model"))],
        D.any_timestamp(g("createdAt")).alias("created_at"),
        D.any_timestamp(g("lastActivityAt")).alias("last_activity_at"),
        F.filter(F.transform(servers, lambda s: s["name"]), lambda n: n.isNotNull() & (n != "")).alias("mcp_servers"),
    )


def with_transcripts(folders: DataFrame, files: DataFrame) -> DataFrame:
    """Sessions ``(folder, meta)`` with their transcripts' classes; folders without a side file keep null."""
    c = files.withColumn("c", X.transcript_class(F.col("path"))).where("c.kept").select("folder", "path", "c.is_subagent", "c.is_compact", "c.slug")
    return c.join(folders, "folder", "left")


def write_documents(docs: DataFrame, path: str, dry_run: bool = False) -> dict[str, int]:
    """Write good documents as JSON lines; the committer makes files appear whole or not at all. A dry run
    only counts documents and bytes."""
    good = docs.where("error_kind is null")
    n = good.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("doc")), F.lit(0)).alias("b")).first()
    if not dry_run:
        good.select(F.col("doc").alias("value")).write.mode("error").text(path)
    return {"documents": n.n, "bytes": n.b}


def build_documents(sessions: DataFrame, events: DataFrame, source: str = "sessions", exporter: tuple[str, str, str, str] = ("loomstone", "1", "tables", "1970-01-01T00:00:00.000Z"), max_depth: int = 16) -> DataFrame:
    """``(session_id, created_at, doc)``: each session's document as JSON without null keys, with its event tree.

    ``created_at`` is the side file's, else the first event's, else 1970. Folders and branches are
    distinct and sorted, distinct before they are brought together. Events are in order of their paths; those below a
    subagent event become its ``events``, from the deepest level up. A document is one value, as large as its session.
    """
    first = events.groupBy("session_id").agg(F.min("ts").alias("first_ts"))

    def values(c: str, name: str) -> DataFrame:
        d = events.where(F.coalesce(F.col(c), F.lit("")) != "").select("session_id", c).distinct()
        return d.groupBy("session_id").agg(F.sort_array(F.collect_list(c)).alias(name))

    x = sessions.join(first, "session_id", "left").join(values("cwd", "cwds"), "session_id", "left").join(values("git_branch", "gitBranches"), "session_id", "left")
    x = x.join(event_trees(events, max_depth), "session_id", "left")
    created = F.coalesce("created_at", "first_ts", F.timestamp_seconds(F.lit(0)))
    head = F.struct(
        F.lit(SCHEMA_VERSION).alias("schemaVersion"), F.struct(*[F.lit(x).alias(n) for n, x in zip(("name", "version", "sourceFormat", "exportedAt"), exporter)]).alias("_exporter"), F.lit(source).alias("source"), F.col("session_id").alias("sessionId"), F.col("session_slug").alias("sessionSlug"), F.col("workspace_id").alias("workspaceId"), F.col("title").alias("title"),
        D.iso_millis(created).alias("createdAt"), D.iso_millis(F.col("last_activity_at")).alias("lastActivityAt"), F.col("model").alias("model"), F.col("account").alias("account"), F.col("cwds"), F.col("gitBranches"), F.col("mcp_servers").alias("mcpServers"),
    )
    doc = F.concat(F.regexp_replace(F.to_json(head), r"\}$", ""), F.lit(',"events":'), F.coalesce("tree", F.lit("[]")), F.lit("}"))
    return x.select("session_id", created.alias("created_at"), doc.alias("doc"))


def event_trees(events: DataFrame, max_depth: int = 16) -> DataFrame:
    """``(session_id, tree)``: the events of each session as a JSON array, inner ones inside their subagent event.
    Events of kinds that a document does not know, and inner ones whose subagent event is missing, are left out."""
    e = events.where(F.col("kind").isin(EVENT_KINDS) & F.col("path").isNotNull())
    depths = [r[0] for r in e.where(F.col("depth") <= max_depth).select("depth").distinct().collect()]
    below = None
    for depth in sorted(depths, reverse=True):
        level = e.where(F.col("depth") == depth)
        level = level.join(below, ["session_id", "path"], "left") if below is not None else level.withColumn("inner", F.lit(None).cast("string"))
        own = F.struct("kind", D.iso_millis(F.col("ts")).alias("ts"), "uuid", "cwd", F.col("git_branch").alias("gitBranch"), "text", "tool", "summary", F.col("subagent_slug").alias("subagentSlug"), F.col("parent_tool_use_id").alias("parentToolUseId"))
        sub = F.concat(F.regexp_replace(F.to_json(own), r"\}$", ""), F.lit(',"events":'), F.coalesce("inner", F.lit("[]")), F.lit("}"))
        json = F.when(F.col("kind") == "subagent", sub).otherwise(F.to_json(own))
        up = F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0)))
        items = F.array_sort(F.collect_list(F.struct("path", json.alias("j"))))
        below = level.groupBy("session_id", up.alias("path")).agg(F.concat(F.lit("["), F.array_join(F.transform(items, lambda i: i["j"]), ","), F.lit("]")).alias("inner"))
    if below is None:
        return events.select("session_id", F.lit(None).cast("string").alias("tree")).limit(0)
    return below.where(F.size("path") == 0).select("session_id", F.col("inner").alias("tree"))


def discover_sessions(spark: SparkSession, root: str, max_depth: int = 4) -> DataFrame:
    """``(folder, meta)`` of the session folders ``local_*`` at most ``max_depth`` below a root, with the text of the
    side file ``<folder>.json`` beside each, null where there is none. Folders are known by the files below them, as
    object stores have no others. Listing is Spark's; the text is read of side files only."""
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    below = r"^(.*?/local_[^/]+)/[^/].*$"
    base = root.rstrip("/").rsplit("/", 1)[-1]
    inside = F.regexp_extract("path", below, 1)
    side = F.col("path").rlike(r"/local_[^/]+\.json$")
    depth = F.size(F.split(F.substring_index("folder", f"/{base}/", -1), "/"))
    folders = scan.select(F.when(inside != "", inside).otherwise(F.when(side, F.regexp_replace("path", r"\.json$", ""))).alias("folder"), (inside != "").alias("is_folder"))
    folders = folders.where("folder is not null").groupBy("folder").agg(F.bool_or("is_folder").alias("is_folder")).where((depth <= max_depth) & F.col("is_folder")).select("folder")
    texts = scan.where(side).select(F.regexp_replace("path", r"\.json$", "").alias("folder"), F.decode("content", "UTF-8").alias("meta"))
    return folders.join(texts, "folder", "left").select(F.regexp_replace("folder", "^file:/+", "/").alias("folder"), "meta")


class ConfigError(ValueError):
    """A settings file is missing or not what it must be."""


def load_config(spark: SparkSession, files: dict[str, str], schemas: dict[str, dict[str, type]]) -> dict[str, dict]:
    """Settings by name from one JSON file each, from any file system; a missing file, a missing key or a value of another type is
    an error, never a default. A list must hold strings only."""
    out = {}
    for name, path in files.items():
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            raise ConfigError(f"{name}: {path} is missing")
        try:
            got = json.loads(spark.read.text(path, wholetext=True).first()[0])
        except json.JSONDecodeError as e:
            raise ConfigError(f"{name}: {e}") from e
        for key, kind in schemas[name].items():
            value = got.get(key) if isinstance(got, dict) else None
            if not isinstance(value, kind) or kind is list and not all(isinstance(x, str) for x in value):
                raise ConfigError(f"{name}: {key} is no {kind.__name__}")
        out[name] = {k: got[k] for k in schemas[name]}
    return out
