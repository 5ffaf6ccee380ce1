"""A mailbox as a Python data source: pages of messages with the filters pushed to the server."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator
from email.utils import parsedate_to_datetime
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, GreaterThanOrEqual, InputPartition

from loomstone.operators import tables as T

SCHEMA = (
    "id string, subject string, body_type string, body string, sender string, recipients array<string>, sent_at string, received_at string, web_link string, folder string, is_draft boolean"
)
PAGE, MOST = 100, 500
FIELDS = ["id", "subject", "body", "from", "toRecipients", "ccRecipients", "bccRecipients", "sentDateTime", "receivedDateTime", "webLink", "parentFolderId", "isDraft"]


def first_url(base: str, folder: str | None, since: str, page: int = PAGE) -> str:
    """The query of the first page: chosen fields, sent since, in order of sending."""
    from urllib.parse import quote, urlencode

    where = f"{base}/mailFolders/{quote(folder, safe='')}/messages" if folder else f"{base}/messages"
    return where + "?" + urlencode({"$select": ",".join(FIELDS), "$filter": f"sentDateTime ge {since}", "$orderby": "sentDateTime asc", "$top": page}, quote_via=quote)


def retry_after(value: str | None, now: float) -> float | None:
    """Seconds to wait by a Retry-After header: a number or an HTTP date; null if neither."""
    if not value:
        return None
    if value.strip().isdigit():
        return float(value)
    try:
        return max(0.0, parsedate_to_datetime(value).timestamp() - now)
    except (TypeError, ValueError):
        return None


def flat(message: dict[str, Any], folder: str | None) -> tuple:
    def address(x: Any) -> str | None:
        return ((x or {}).get("emailAddress") or {}).get("address") or None

    body = message.get("body") or {}
    to = [a for k in ("toRecipients", "ccRecipients", "bccRecipients") for a in map(address, message.get(k) or []) if a]
    return (
        message.get("id"), message.get("subject"), body.get("contentType"), body.get("content"), address(message.get("from")), to,
        message.get("sentDateTime"), message.get("receivedDateTime"), message.get("webLink"), folder or message.get("parentFolderId"), bool(message.get("isDraft", False)),
    )


class MailboxError(RuntimeError):
    """The server did not answer as it should, after all attempts."""


Fetch = Callable[[str], tuple[int, dict[str, str], str]]
"""``url -> (status, headers with small names, body)``: the transport, given by the caller."""


def server_pages(fetch: Fetch, first: str, attempts: int = 4, base_ms: int = 1_000, most_ms: int = 60_000, wait: Callable[[float], None] = time.sleep, now: Callable[[], float] = time.time) -> Iterator[dict]:
    """Pages of a query, one after the other by their next links.

    Status 429 and 5xx are tried again, at most ``attempts`` times in all, after what Retry-After asks for, else
    after ``base_ms`` doubled each time, ``most_ms`` at most. Any other status than 200 is an error.
    """
    url: str | None = first
    while url:
        for n in range(attempts):
            status, headers, body = fetch(url)
            if status == 200:
                break
            if status != 429 and status < 500 or n + 1 == attempts:
                raise MailboxError(f"status {status} after {n + 1} attempts")
            asked = retry_after(headers.get("retry-after"), now())
            wait(asked if asked is not None else min(base_ms * 2**n, most_ms) / 1000)
        page = json.loads(body)
        yield page
        url = page.get("@odata.nextLink")


def landed_pages(folder: str) -> Callable[[str | None], Iterator[dict]]:
    """The default transport: pages that were landed as JSON files, one folder per mail folder, in order of their names."""

    def pages(mail_folder: str | None) -> Iterator[dict]:
        where = os.path.join(folder, mail_folder) if mail_folder else folder
        for name in sorted(os.listdir(where)):
            if name.endswith(".json"):
                with open(os.path.join(where, name)) as f:
                    yield json.load(f)

    return pages


def sent(message: dict[str, Any]) -> str:
    return message.get("sentDateTime") or message.get("receivedDateTime") or ""


class MailboxSource(DataSource):
    """``spark.read.format("mailbox").option("path", ...).option("folders", "a,b").option("since", iso)``.

    ``most`` bounds the messages of one run over all folders, in the order they are named, as the mail server's
    owner asks; ``most`` of 0 is no bound, and then each folder is a partition of its own. A folder is read in
    order of sending, so ``folder_checkpoints`` says how far each was read, and a later run goes on from there:
    ``since`` may be a JSON object of one time per folder. With ``pushdown`` set to ``true`` (and Spark's setting for
    Python sources on) a filter ``sent_at >= ...`` is pushed to the server.
    """

    @classmethod
    def name(cls) -> str:
        return "mailbox"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        push = str(self.options.get("pushdown", "")).lower() == "true"
        return (PushdownMailboxReader if push else MailboxReader)(self.options)


class MailboxReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.folders: list[str | None] = [f for f in options.get("folders", "").split(",") if f] or [None]
        since = options.get("since", "")
        self.since: dict[str, str] = json.loads(since) if since.startswith("{") else {f or "": since for f in self.folders}
        self.most = int(options.get("most", MOST))

    def partitions(self):
        if self.most:  # the bound holds for all folders together, so one task counts
            return [InputPartition(list(self.folders))]
        return [InputPartition([f]) for f in self.folders]

    def read(self, partition):
        left = self.most or -1
        for folder in partition.value:
            since = self.since.get(folder or "", "")
            for page in landed_pages(self.path)(folder):
                for m in page.get("value") or []:
                    if sent(m) < since:
                        continue
                    if not left:
                        return
                    left -= 1
                    yield flat(m, folder)


class PushdownMailboxReader(MailboxReader):
    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, GreaterThanOrEqual) and f.attribute == ("sent_at",):
                self.since = {x or "": max(self.since.get(x or "", ""), f.value) for x in self.folders}
            yield f  # a message without a time of sending is judged by Spark again


def folder_checkpoints(read: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """``(folder, since)``: how far each folder was read, the greatest time of sending among what was read.
    Folders of which nothing was read keep the time they had."""
    got = read.where(F.col("folder").isNotNull()).groupBy("folder").agg(F.max(F.coalesce("sent_at", "received_at")).alias("since"))
    return got if existing is None else T.upsert_max(existing, got, "folder", "since")
