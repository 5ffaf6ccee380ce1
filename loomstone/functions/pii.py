"""The pattern pass over personal data: eight rules by priority, replaced right to left.

Candidates are ordered by start, then length (the longer first), then priority, and one is taken
if it starts behind the last taken. A candidate that fails its check is dropped and the scan goes
on behind it. Offsets are code points of the original text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomstone.functions.text import BLANKS

SPACE = f"[{BLANKS}]"


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def _card(raw: str) -> bool:
    d = re.sub(r"\D", "", raw)
    return 13 <= len(d) <= 19 and luhn(d)


_octet = r"(?:25[0-5]|2[0-4]\d|[01]?\d\d?)"
# What each rule accepts, in order of priority.
RULES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", None),
    ("phone", r"(?<![\w.])\+[1-9]\d{6,14}(?!\d)", None),
    ("phone", rf"(?<![\w.])(?:\(\d{{3}}\){SPACE}?\d{{3}}[-. ]\d{{4}}|\d{{3}}[-. ]\d{{3}}[-. ]\d{{4}})(?!\d)", None),
    ("phone", r"(?<![\w.])\d{10}(?!\d)", None),
    ("sin", r"\b\d{3}-\d{3}-\d{3}\b", lambda m: luhn(m.replace("-", ""))),
    ("cc", r"(?<!\d)(?:\d[ -]?){13,19}(?!\d)", _card),
    ("ipv4", rf"(?<![\w.])(?:{_octet}\.){{3}}{_octet}(?![\w.])", None),
    ("ipv6", r"(?<![\w:])(?:[0-9a-fA-F]{1,4}:){2,7}[0-9a-fA-F]{1,4}(?![\w:])", None),
]
# What stands in place of each type.
PLACEHOLDERS = {"email": "[REDACTED_EMAIL]", "phone": "[REDACTED_PHONE]", "sin": "[REDACTED_SIN]", "cc": "[REDACTED_CC]", "ipv4": "[REDACTED_IP]", "ipv6": "[REDACTED_IP]"}
_COMPILED = [(i, kind, re.compile(p, re.ASCII), check) for i, (kind, p, check) in enumerate(RULES)]


def scan(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, type)`` of what the rules take."""
    found = []
    for priority, kind, pattern, check in _COMPILED:
        for m in pattern.finditer(text):
            if check is None or check(m[0]):
                found.append((m.start(), m.start() - m.end(), priority, m.end(), kind))
    out: list[tuple[int, int, str]] = []
    end = 0
    for start, _, _, stop, kind in sorted(found):
        if start >= end:
            out.append((start, stop, kind))
            end = stop
    return out


RESULT = "status string, text string, log array<struct<type string, offset int, replacement string>>"


def regex_pass(c: Column) -> Column:
    """``{status, text, log}``. Null text: null text, empty log. An error blocks the row: its text is
    empty and its status ``blocked``, never the original."""

    @F.pandas_udf(RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                try:
                    if t is None:
                        rows.append(("redacted", None, []))
                        continue
                    out, at, log = [], 0, []
                    for s, e, kind in scan(t):
                        put = PLACEHOLDERS[kind]
                        out += [t[at:s], put]
                        log.append({"type": kind, "offset": s, "replacement": put})
                        at = e
                    rows.append(("redacted", "".join(out) + t[at:], log))
                except Exception:  # fail closed
                    rows.append(("blocked", "", []))
            yield pd.DataFrame(rows, columns=["status", "text", "log"])

    return run(c)


def types_found(c: Column) -> Column:
    """The types of what the rules take of a text, in order; neither texts nor logs leave the worker."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[kind for _, _, kind in scan(t)] if t else [] for t in texts], dtype=object)

    return run(c)


def luhn_ok(c: Column) -> Column:
    """Luhn's check of the digits of a text; false without digits."""
    digits = F.regexp_replace(c, "[^0-9]", "")
    return F.coalesce((F.length(digits) > 0) & F.call_function("luhn_check", digits), F.lit(False))
