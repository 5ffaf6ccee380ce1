"""What the sender newly wrote in an e-mail.

Paragraphs, and in them lines and sentences, are compressed with a dictionary per kind of foreign part: what
introduces earlier messages of a thread, closings of senders, standing notices. The dictionaries are counted over all
mails, each distinct text once, by where things stand: lines directly above marked runs and blocks of header lines;
short lines that end what a mail's own sender wrote; sentences that share a paragraph with one that compresses like
a notice. Only what recurs at such places far more than elsewhere gets in; a few seed lines in each language begin the
counting. A part that compresses abnormally better with a dictionary than without is suspected of its kind;
the suspicion holds if an exact overlap of words with the dictionary verifies it. Marks at the beginning of lines and
blocks of header lines show where an earlier message runs. All else is kept as newly written.

Dictionaries are of any size. Their most usual lines are a page that every part is compressed with; of the lines behind
it, those that share words with a part join the page for that part. Many such lines reach their mails by a join.
"""

from __future__ import annotations

import copy
import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import by_bytes, cut, kind_key

KINDS = ("quoted", "signature", "disclaimer")
DICTIONARY_BYTES = 12_288
"""Of the page of a dictionary: its most usual lines, which every part is compressed with."""
HELD_BYTES = 1 << 20
"""Lines of all dictionaries up to this size are held with the pages; beyond it they reach their mails by a join, with the same result."""
LEAST = 3
"""What stands in fewer mails does not recur and is in no dictionary."""
PIECE = 1_900
"""Longer lines and texts are compressed in pieces of so many characters: page, lines and piece lie in one window of 32 KB."""
GAIN = {"quoted": 0.20, "signature": 0.25, "disclaimer": 0.25}
"""The part of a part's compressed size that a dictionary must save for a suspicion."""
OVERLAP, OVERLAP_LAST = 0.5, 0.3
"""The part of a sentence's words in triples of the dictionary that verifies it; the latter where nothing newly written follows."""
BLOCK_LINES, BLOCK_CHARS, INTRO_CHARS = 8, 90, 300
"""A closing block has at most so many lines of at most so many characters; an introduction so many characters."""


class Span(NamedTuple):
    start: int
    end: int
    kind: str


# Usual header names, introductions, closings and notices that begin the dictionaries.
SEEDS = {
    "quoted": """On Mon, Jan 1, 2025 at 10:00, [REDACTED_PERSON] <[REDACTED_EMAIL]> wrote:
On 1/1/2025 10:00, [REDACTED_PERSON] wrote:
Am 1.1.2025 um 10:00 schrieb [REDACTED_PERSON] <[REDACTED_EMAIL]>:
Le 1 janvier 2025 à 10:00, [REDACTED_PERSON] <[REDACTED_EMAIL]> a écrit :
El 1/1/2025 a las 10:00, [REDACTED_PERSON] escribió:
-----Original Message-----
-------- Forwarded Message --------
-----Message d'origine-----
-----Ursprüngliche Nachricht-----
Begin forwarded message:
________________________________""",
    "signature": """Kind regards,
Best regards,
Yours sincerely,
Cordialement,
Mit freundlichen Grüßen
Atentamente,
[REDACTED_PERSON]
[REDACTED_EMAIL]
[REDACTED_PHONE]
T: [REDACTED_PHONE]
Sent from my tablet, please excuse any typos
Sent from my phone
Envoyé de mon téléphone
Von meinem Telefon gesendet""",
    "disclaimer": """This e-mail and any attachments are confidential and intended solely for the use of the individual or entity to whom it is addressed.
This message and any files transmitted with it may contain confidential material and are intended only for the named addressee.
If you have received this e-mail in error, please notify the sender and delete it from your system.
If this message has reached you by mistake, please destroy every copy.
Any unauthorised copying, disclosure or distribution of this message is strictly prohibited.
The views expressed in this e-mail are those of the author and do not represent those of the company.
The company accepts no liability for any damage caused by viruses transmitted by this e-mail.
No contract may be concluded by e-mail.
Please consider the environment before printing this e-mail.
To unsubscribe, reply to this e-mail with STOP.
Confidentiality notice: the contents of this message are intended for the named recipient only.
Ce courriel et ses pièces jointes sont confidentiels et réservés à leur destinataire.
Merci de penser à l'environnement avant d'imprimer ce courriel.
Si vous avez reçu ce message par erreur, veuillez le détruire et avertir l'expéditeur.
Diese E-Mail enthält vertrauliche Informationen und ist nur für den genannten Empfänger bestimmt.
Wenn Sie diese Nachricht irrtümlich erhalten haben, informieren Sie bitte den Absender und löschen Sie sie.""",
}
# Names of header lines, and of those the ones that no other list of keys holds.
HEADER_KEYS = {"from", "sent", "to", "cc", "bcc", "subject", "date", "reply-to", "de", "envoyé", "à", "objet", "von", "gesendet", "an", "betreff", "datum", "para", "asunto", "enviado"}
DECIDING_KEYS = {"sent", "subject", "date", "envoyé", "objet", "gesendet", "betreff", "datum", "asunto", "enviado"}

_HEADER = re.compile(r"^\*?([^\W\d_][\w-]{0,11})\s?:\*?(?:\s|$)")
_TABLE = re.compile(r"^\|(?:[^|\n]*\|){2,}\s*$")
_PREFIXED = re.compile(r"^[ \t]?[>|]")
_RULER = re.compile(r"^[-—_~*=]{2,}[ \t]*$")
_NAME = r"[A-ZÀ-Þ][\w'’-]+"
_PERSON = re.compile(rf"^(?:\[REDACTED_PERSON\]|(?:{_NAME}|[A-ZÀ-Þ]\.)(?:[ -](?:{_NAME}|[A-ZÀ-Þ]\.)){{1,3}})\s*$")
_TWO_NAMES = re.compile(rf" {_NAME} {_NAME}(?= |$)")
_EMAIL = re.compile(r"[\w.+%-]+@[\w-]+(?:\.[\w-]+)+")
_PHONE = re.compile(r"(?<![\w-])(?!\d{4}-\d\d-\d\d|\d{1,2}\.\d{1,2}\.\d{4})\+?\(?\d[\d ().-]{6,}\d(?![\w-])")
_CONTACT = re.compile(r"^(?:\w{1,8}\s?[:.]?\s)?(?:\[REDACTED_(?:PHONE|EMAIL)\](?: ext\.? \d+)?)\s*$")
_SENTENCE = re.compile(r"[.?!;:]\s*$")
_SENTENCE_END = re.compile(r"[.?!][\"')\]]*\s+")
_TOKEN = re.compile(r"\w+")
_mask_digits = re.compile(r"\d")
_strip_prefix = re.compile(r"^(?:[>|] ?)+")


def mask(line: str) -> str:
    return _mask_digits.sub("0", _strip_prefix.sub("", line)).strip()


def plain(line: str) -> str:
    """A line with its contacts and name masked, as they differ from sender to sender."""
    line = line.strip()
    if _PERSON.match(line):
        return "[REDACTED_PERSON]"
    if "@" in line:
        line = _EMAIL.sub("[REDACTED_EMAIL]", line)
    return mask(_PHONE.sub("[REDACTED_PHONE]", line))


def _triples(words: list[str]) -> list[tuple[str, ...]]:
    return [tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))]


def _short(line: str) -> bool:
    """A line as closing blocks have them: short, no sentence, no marked or fenced one."""
    return 0 < len(line) <= BLOCK_CHARS and not (_SENTENCE.search(line) and not _PERSON.match(line)) and not _PREFIXED.match(line) and not line.startswith("```")


def _grams(text: str) -> set[tuple[str, ...]]:
    """What a text may share with lines: its word triples, and in short ones also pairs and words, which short lines are."""
    words = _TOKEN.findall(text.lower())
    sizes = (1, 2, 3) if len(text) <= BLOCK_CHARS else (3,)
    return {tuple(words[i : i + k]) for k in sizes for i in range(len(words) - k + 1)}


def _size(raw: bytes, preset: bytes = b"") -> int:
    z = zlib.compressobj(6, zlib.DEFLATED, -15, 8, zlib.Z_DEFAULT_STRATEGY, preset) if preset else zlib.compressobj(6, zlib.DEFLATED, -15, 8)
    return len(z.compress(raw)) + len(z.flush())


class Dictionary:
    """A preset compression dictionary, its lines and its word triples (shorter lines whole): a page of the most usual
    lines, and for the triples of the lines behind it the most usual line that has each."""

    def __init__(self, lines: Iterable[str], weights: dict[str, int] | None = None):
        ordered = list(dict.fromkeys(lines))
        n, size = 0, 0
        while n < len(ordered) and size + (b := len(ordered[n].encode("utf-8", "replace")) + 1) <= DICTIONARY_BYTES:
            n, size = n + 1, size + b
        self.page = set(ordered[:n])
        self.triples = {x for line in ordered[:n] if (words := _TOKEN.findall(line.lower())) for x in _triples(words)}
        # The most usual lines stand last, where they are the nearest.
        self.preset = "\n".join(reversed(ordered[:n])).encode("utf-8", "replace")
        self._hold([(-(weights or {}).get(x, 0), x) for x in ordered[n:]])

    def _hold(self, behind: list[tuple[int, str]]) -> None:
        self.behind = {line for _, line in behind}
        self.held: dict[tuple[str, ...], tuple[int, str]] = {}
        for x in sorted(behind):
            if words := _TOKEN.findall(x[1].lower()):
                for t in _triples(words):
                    self.held.setdefault(t, x)

    def with_lines(self, behind: list[tuple[int, str]]) -> Dictionary:
        """This page with other lines behind it, ``(- mails, line)``."""
        d = copy.copy(self)
        d._hold(behind)
        return d

    @property
    def lines(self) -> set[str]:
        return self.page | self.behind

    def __contains__(self, line: str) -> bool:
        return line in self.page or line in self.behind

    def overlap(self, line: str) -> float:
        """The part of a masked line's words that stand in triples of the dictionary."""
        words = _TOKEN.findall(line.lower())
        if not words:
            return 0.0
        covered = [False] * len(words)
        for i, x in enumerate(_triples(words)):
            if x in self.triples or x in self.held:
                covered[i : i + 3] = [True] * len(x)
        return sum(covered) / len(words)

    def near(self, text: str) -> tuple[tuple[int, str], ...]:
        """The lines behind the page that share words with the text, the most usual first."""
        if not self.held:
            return ()
        return tuple(sorted({self.held[x] for line in text.split("\n") for x in _grams(line) if x in self.held}))

    def _presets(self, near: tuple[tuple[int, str], ...]) -> Iterator[bytes]:
        if not near:
            yield self.preset
        lo, size = 0, 0
        for i, (_, line) in enumerate(near):
            b = len(line.encode("utf-8", "replace")) + 1
            if i > lo and size + b > DICTIONARY_BYTES:
                yield b"\n".join([self.preset, *(x.encode("utf-8", "replace") for _, x in reversed(near[lo:i]))])
                lo, size = i, 0
            size += b
        if near:
            yield b"\n".join([self.preset, *(x.encode("utf-8", "replace") for _, x in reversed(near[lo:]))])

    def gain(self, text: str, near: tuple[tuple[int, str], ...] | None = None) -> float:
        """The part of the text's compressed size that the dictionary saves."""
        a = b = 0
        for lo in range(0, len(text), PIECE):
            piece = text[lo : lo + PIECE]
            raw = piece.encode("utf-8", "replace")
            a += _size(raw)
            b += min(_size(raw, p) for p in self._presets(near if near is not None and len(text) <= PIECE else self.near(piece)))
        return (a - b) / a if a else 0.0


# --- structure -----------------------------------------------------------------------------


def _header_block(lines: list[str], i: int) -> int:
    """The line behind a block of two or more header lines that begins here, or i."""
    j, keys = i, set()
    while j < len(lines) and (m := _HEADER.match(lines[j])) and (key := m[1].lower()) in HEADER_KEYS and key not in keys:
        keys.add(key)
        j += 1
    return j if j - i >= 2 and keys & DECIDING_KEYS else i


def _split_lines(text: str) -> tuple[list[tuple[int, int]], list[str]]:
    """Where each line lies, without its end, and its text; marks at its beginning are kept."""
    at, lo = [], 0
    for m in re.finditer(r"\r?\n", text):
        at.append((lo, m.start()))
        lo = m.end()
    at.append((lo, len(text)))
    return at, [_line(text[a:b]) for a, b in at]


def _line(raw: str) -> str:
    return raw.rstrip() if _PREFIXED.match(raw) else raw.strip(" \t\r")


def _marked(line: str) -> bool:
    return _PREFIXED.match(line) is not None and not _TABLE.match(line)


def _sentences(text: str, lo: int, hi: int) -> list[tuple[int, int]]:
    cuts = [lo, *(m.end() for m in _SENTENCE_END.finditer(text, lo, hi)), hi]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]


# --- counting ------------------------------------------------------------------------------

ROLES = ("quoted", "opener", "signature", "lone", "disclaimer", "all")
_seeds: dict[str, Dictionary] = {}


def _seed(kind: str) -> Dictionary:
    if kind not in _seeds:
        _seeds[kind] = Dictionary([mask(x) for x in SEEDS[kind].split("\n")])
    return _seeds[kind]


def _count(mails: Iterable[str | None]) -> dict[str, list[int]]:
    """In how many mails each masked line or sentence stands in each role."""
    counts: dict[str, list[int]] = {}
    for text in mails:
        if not text or not text.strip():
            continue
        seen: set[tuple[str, int]] = set()
        if "\n" in text.strip():
            _roles(text, seen)
        for unit, role in seen:
            if unit:
                counts.setdefault(unit, [0] * len(ROLES))[role] += 1
    return counts


def _lines(unit: str, quoted: int, opener: int, closing: int, lone: int, notice: int, n: int) -> Iterator[tuple[str, str, int, bool, bool]]:
    """``(kind, line, mails, opens a block, stands alone)`` of a unit that belongs in a dictionary, by the mails in each role."""
    n, words = max(n, 1), len(_TOKEN.findall(unit))
    if quoted * 2 >= n and quoted > closing + lone:  # closings stand above headers too
        kind, weight = "quoted", quoted
    elif notice * 5 >= n * 3 and words >= 3:
        kind, weight = "disclaimer", notice
    elif (closing + lone) * 5 >= n * 4 or closing * 2 >= n:
        kind, weight = "signature", closing + lone
    else:
        return
    closes = kind == "signature"
    for lo in range(0, len(unit), PIECE):
        yield kind, unit[lo : lo + PIECE], weight, closes and opener * 2 >= n and not unit.startswith("[REDACTED"), closes and lone * 2 >= n and words >= 3


def _head(line: str) -> str | None:
    """The words that begin a notice, by which it is found where line breaks are lost."""
    words = line.split()
    return " ".join(words[:3]) if len(words) >= 4 else None


def _roles(text: str, seen: set[tuple[str, int]]) -> None:
    at, lines = _split_lines(text)
    n = len(lines)
    foreign = [False] * n  # below a header or marked: not this sender's
    i = 0
    while i < n:
        if _marked(lines[i]):
            above = i - 1 if i and lines[i - 1] else i - 2
            if above >= 0 and not _marked(lines[above]) and lines[above].endswith(":"):
                seen.add((plain(lines[above]), 0))
                foreign[above] = True
            while i < n and (_marked(lines[i]) or not lines[i]):
                foreign[i] = True
                i += 1
        elif (e := _header_block(lines, i)) > i:
            above = i - 1
            while above >= 0 and not lines[above]:
                above -= 1
            if above >= 0 and not foreign[above] and len(lines[above]) < 60:
                seen.add((plain(lines[above]), 0))
                foreign[above] = True
            seen.update((plain(x), 0) for x in lines[i:e])
            foreign[i:] = [True] * (n - i)
            break
        else:
            i += 1
    own = [k for k in range(n) if lines[k] and not foreign[k]]
    for k in range(n):
        if lines[k]:
            seen.add((plain(lines[k]), 5))
    # Paragraphs of the sender; sentences in one with a notice; the short lines that end one.
    i, paragraphs = 0, []
    d = _seed("disclaimer")
    while i < len(own):
        j = i + 1
        while j < len(own) and own[j] == own[j - 1] + 1:
            j += 1
        parts = [mask(" ".join(text[a:b].split())) for a, b in _sentences(text, at[own[i]][0], at[own[j - 1]][1])]
        alike = sum(len(x) >= 20 and d.overlap(x) >= 0.25 and d.gain(x) >= 0.2 for x in parts)
        notice = alike > 1 or alike == 1 and len(parts) <= 3
        seen.update((x, 5) for x in parts)
        if notice:
            seen.update((x, 4) for x in parts)
        paragraphs.append((own[i:j], notice))
        i = j
    ends = max((k for k, (_, notice) in enumerate(paragraphs) if not notice), default=0)
    for k, (rows, _) in enumerate(paragraphs):
        if all(_short(lines[r]) for r in rows):
            if len(rows) > 1:
                seen.update((plain(lines[r]), 2) for r in rows)
                seen.add((plain(lines[rows[0]]), 1))
            elif k and k == ends:
                seen.add((plain(lines[rows[0]]), 3))


class MailModel:
    """The three dictionaries, and which of the closing lines open a block or stand alone."""

    def __init__(self, mails: Iterable[str | None] = ()):
        self._settle(line for u, c in _count(mails).items() if c[5] >= LEAST for line in _lines(u, *c))

    @classmethod
    def of_lines(cls, lines: Iterable[tuple], behind: DataFrame | None = None) -> MailModel:
        """From ``(kind, line, mails, opens a block, stands alone)``; ``behind`` are lines that reach their mails by a join."""
        model = cls.__new__(cls)
        model._settle(lines)
        model.behind = behind
        return model

    def _settle(self, lines: Iterable[tuple]) -> None:
        self.suspicions: dict[tuple, float] = {}
        self.own = False  # whether the lines behind the pages are those of one mail
        self.behind: DataFrame | None = None
        rows = list(lines)
        self.of = {}
        for k in KINDS:
            weights = Counter()
            for kind, line, weight, *_ in rows:
                if kind == k:
                    weights[line] = max(weights[line], weight)
            self.of[k] = Dictionary([mask(x) for x in SEEDS[k].split("\n")] + [u for u, _ in sorted(weights.items(), key=lambda x: (-x[1], x[0]))], weights)
        seeds = [mask(x) for x in SEEDS["signature"].split("\n")]
        page = self.of["signature"].page
        self.page_openers = {*seeds[:6], *(x for _, x, _, opener, _ in rows if opener and x in page)}
        self.page_lone = {*seeds[-3:], *(x for _, x, _, _, lone in rows if lone and x in page)}
        self.page_heads = {h for x in self.of["disclaimer"].page if (h := _head(x))}
        self.begins = _begins(self.page_openers, self.page_lone, self.page_heads)
        self._behind([r for r in rows if r[1] not in self.of[r[0]].page])

    def _behind(self, rows: list[tuple]) -> None:
        """Take in the lines behind the pages."""
        self.openers = self.page_openers | {x for _, x, _, opener, _ in rows if opener}
        self.lone = self.page_lone | {x for _, x, _, _, lone in rows if lone}
        self.starts: dict[tuple[str, ...], set[tuple[str, str]]] = {}
        for kind, line, _, opener, lone in rows:
            for what, x in _starts(kind, line, opener, lone):
                self.starts.setdefault(tuple(_TOKEN.findall(x.lower())[:3]), set()).add((what, x))

    def with_lines(self, rows: list[tuple]) -> MailModel:
        """The pages with other lines behind them, ``(kind, line, mails, opens a block, stands alone)``."""
        m = copy.copy(self)
        m.own = True
        m.of = {k: self.of[k].with_lines([(-w, x) for kind, x, w, *_ in rows if kind == k]) for k in KINDS}
        m._behind(rows)
        return m

    def flat(self, text: str) -> MailModel:
        """The model for a text that has lost its line breaks, with what may begin a foreign part in it."""
        words = _TOKEN.findall(mask(text).lower()) if self.starts else []
        met = {x for k in range(4) for i in range(len(words) - k + 1) for x in self.starts.get(tuple(words[i : i + k]), ())} if self.starts else set()
        m = copy.copy(self)
        m.openers = self.page_openers | {x for what, x in met if what == "opener"}
        m.lone = self.page_lone | {x for what, x in met if what == "lone"}
        if met:
            m.begins = _begins(m.openers, m.lone, self.page_heads | {x for what, x in met if what == "head"})
        return m

    def pieces(self, text: str) -> list[tuple[int, int]]:
        """The lines of a text that has lost its line breaks."""
        cuts, inside = [0], 0
        for m in self.begins.finditer(text):
            if m["sender"] is None:
                cuts.append(m.end())
            elif m.end() >= inside:  # what follows a sender's name is still of that sender
                cuts.append(m.end())
                inside = m.end("sender")
        cuts.append(len(text))
        return [(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]

    def suspected(self, text: str, kind: str) -> bool:
        """Whether the text compresses abnormally better with the dictionary of the kind."""
        near = self.of[kind].near(text) if self.own else None  # else the same whenever the text is the same
        key = (kind, text, near)
        g = self.suspicions.get(key)
        if g is None:
            g = self.of[kind].gain(text, near)
            if len(self.suspicions) > 50_000:  # a worker's cache of answers
                self.suspicions.clear()
            self.suspicions[key] = g
        return g >= GAIN[kind]

    def overlap(self, text: str, kind: str) -> float:
        """How much of the text's words overlaps exactly with the dictionary of the kind."""
        return self.of[kind].overlap(text)

    def verified(self, text: str, kind: str, least: float) -> bool:
        """Whether so much of the text's words overlaps exactly."""
        return self.overlap(text, kind) >= least

    def __getstate__(self) -> dict:
        return self.__dict__ | {"suspicions": {}, "behind": None}  # answers stay in the worker, tables with the driver


def _starts(kind: str, line: str, opener: bool, lone: bool) -> list[tuple[str, str]]:
    """What of a line begins a foreign part where line breaks are lost."""
    head = _head(line) if kind == "disclaimer" else None
    return [(what, x) for what, x, on in (("opener", line, opener), ("lone", line, lone), ("head", head, head)) if on]


def _begins(openers: set[str], lone: set[str], heads: set[str]) -> re.Pattern:
    """Where a mail has lost its line breaks, it is cut again before what begins a foreign part."""
    person = rf"(?:\[REDACTED_PERSON\]|{_NAME} {_NAME})"
    opens = "|".join(re.escape(o) for o in sorted(openers, key=lambda o: (-len(o), o)) if o and not _RULER.match(o))
    alone = "|".join(re.escape(o) for o in sorted(lone, key=lambda o: (-len(o), o)) if "0" not in o)
    notes = "|".join(re.escape(h) for h in sorted(heads, key=lambda h: (-len(h), h)) if "0" not in h)
    keys = "|".join(sorted({k.capitalize() for k in HEADER_KEYS}, key=lambda k: (-len(k), k)))
    tail = r"(?: (?:[^.?!\[]{3,60} )?(?:\w{1,8}: )?\[REDACTED_(?:PHONE|EMAIL)\])"
    return re.compile(
        rf"[ \t](?=(?P<sender>(?:[-—_~*=]{{2,}}|{opens}) {person}{tail}?|{person}{tail})|(?:{alone})(?:\s|$)|(?:{notes})\s|\*?(?:{keys})\s?:\*? \S|-{{2,}} ?[^\W\d_][^\d-]{{3,40}}-{{2,}}|_{{20,}} "
        rf"|[A-ZÀ-Þ]\w+(?: \w+){{0,3}}:(?= \*?(?:{keys})\s?:)|(?:On|Am|Le|El) [^.?!]{{0,20}}\d[^?!]{{3,160}}?:(?:\s|$)|\d{{4}}-\d\d-\d\d \d\d:\d\d [A-Z]{{3,4}}, [^:]{{3,90}}:|{person}(?: <[^>]+>)? \w+ \w+ \w+day:)"
    )


# --- one mail ------------------------------------------------------------------------------


def foreign(text: str | None, model: MailModel) -> list[Span]:
    """The foreign parts of a mail, in order. A null or blank text has none."""
    if not text or not text.strip():
        return []
    flat = "\n" not in text.strip()
    if flat:
        model = model.flat(text)
        at = model.pieces(text)
        lines = [_line(text[a:b]) for a, b in at]
    else:
        at, lines = _split_lines(text)
    n = len(lines)
    kind: list[str | None] = [None] * n
    _quoted(lines, kind, flat, model)
    overlaps: dict[str, float] = {}
    more = _notices(text, at, lines, kind, flat, model, overlaps)
    _closings(lines, kind, flat, model)
    # What nothing newly written follows is known only now.
    more += _notices(text, at, lines, kind, flat, model, overlaps)
    spans: list[Span] = []
    whole = [Span(*at[i], kind[i]) for i in range(n) if kind[i] and lines[i] and not any(s.start <= at[i][0] and at[i][1] <= s.end for s in more)]
    for x in sorted([*more, *whole]):
        if spans and spans[-1].kind == x.kind and not text[spans[-1].end : x.start].strip():
            spans[-1] = Span(spans[-1].start, x.end, x.kind)
        else:
            spans.append(x)
    return spans


def _introduces(lines: list[str], i: int, flat: bool, model: MailModel) -> int:
    """The line behind what introduces an earlier message here, or i. An introduction may run over two lines."""
    line = lines[i]
    j = i + 1
    while j < len(lines) and not lines[j]:
        j += 1
    below = _header_block(lines, j) if j < len(lines) else j
    if _header_block(lines, i) > i:
        return _header_block(lines, i)
    if below > j and (_RULER.match(line) or len(line) < 60) and model.suspected(plain(line), "quoted") and model.verified(plain(line), "quoted", 0.0 if _RULER.match(line) else OVERLAP):
        return below
    for k in (1,) if flat else (1, 2):
        joined = " ".join(lines[i : i + k])
        if flat:
            joined = joined[: m.end()] if (m := re.search(r"[^\d\s]\s?:(?=\s|$)", joined)) else joined
        if not 8 <= len(joined) <= INTRO_CHARS or k == 2 and (i + 1 >= len(lines) or not lines[i + 1]):
            continue
        dated = joined.endswith(":") and (re.search(r"\d", joined) or re.search(r"\w+day\s?:$|\[REDACTED|@", joined))
        ruled = re.match(r"^-{2,}.*-{2,}$", joined)
        if (dated or ruled) and model.suspected(plain(joined), "quoted") and model.verified(plain(joined), "quoted", OVERLAP):
            return i + k
        nxt = i + k
        # Not in the dictionary, but it stands directly above a marked run and names a time.
        if dated and not flat and nxt < len(lines) and _marked(lines[nxt]) and re.search(r"\d", joined):
            return nxt
    return i


def _quoted(lines: list[str], kind: list[str | None], flat: bool, model: MailModel) -> None:
    n, i = len(lines), 0
    while i < n:
        if not lines[i]:
            i += 1
            continue
        e = i if _marked(lines[i]) and not flat else _introduces(lines, i, flat, model)
        if e > i:
            j = e
            while j < n and not lines[j]:
                j += 1
            if flat or j >= n or not _marked(lines[j]):
                end = n  # without marks, all that follows is the earlier message
            else:
                end = j
                while end < n and (_marked(lines[end]) or not lines[end] and end + 1 < n and _marked(lines[end + 1])):
                    end += 1
            kind[i:end] = ["quoted"] * (end - i)
            i = end
        elif not flat and _marked(lines[i]):
            end = i
            while end < n and _marked(lines[end]):
                end += 1
            # A marked run without introduction: a comparison that begins a line stands beside text and alone.
            if i == 0 or not lines[i - 1] or end - i > 1:
                kind[i:end] = ["quoted"] * (end - i)
            i = end
        else:
            i += 1


def _open(lines: list[str], kind: list[str | None], i: int) -> bool:
    return bool(lines[i]) and kind[i] is None and not _PREFIXED.match(lines[i])


def _notices(text: str, at: list[tuple[int, int]], lines: list[str], kind: list[str | None], flat: bool, model: MailModel, overlaps: dict[str, float]) -> list[Span]:
    """Sentences of unmarked paragraphs, and of paragraphs below an unmarked earlier message, that compress like
    notices and overlap by ``OVERLAP``, or ``OVERLAP_LAST`` where nothing newly written follows. Lines within one are marked."""
    out: list[Span] = []
    last, i = True, len(lines)

    def free(k: int) -> bool:
        return bool(lines[k]) and kind[k] in (None, "quoted") and not _PREFIXED.match(lines[k])

    while i > 0:
        i -= 1
        if not free(i):
            continue
        end, below = i + 1, kind[i] == "quoted"
        while not flat and i > 0 and free(i - 1) and (kind[i - 1] == "quoted") == below:
            i -= 1
        lo, hi = at[i][0], at[end - 1][1]
        parts = _sentences(text, lo, hi)
        hits = []
        for a, b in reversed(parts):
            s = mask(" ".join(text[a:b].split()))
            if s not in overlaps:
                overlaps[s] = model.overlap(s, "disclaimer") if len(s) >= 12 else -1.0
            hit = overlaps[s] >= (OVERLAP_LAST if last and not below else OVERLAP) and model.suspected(s, "disclaimer")
            if hit:
                hits.append(Span(a, a + len(text[a:b].rstrip()), "disclaimer"))
            elif s:
                last = False
        if below and (len(hits) < len(parts) or len(parts) == 1 and len(hits[0:1]) and len(text[lo:hi]) < 40):
            continue  # inside an earlier message only a paragraph that is a notice throughout is the outer mail's
        out += hits
        for k in range(i, end):
            rest, x = "", at[k][0]
            for a, b, _ in sorted(s for s in out if s.start < at[k][1] and s.end > at[k][0]):
                rest, x = rest + text[x:a], max(x, b)
            if not (rest + text[x : at[k][1]]).strip():
                kind[k] = "disclaimer"
    return out


def _closings(lines: list[str], kind: list[str | None], flat: bool, model: MailModel) -> None:
    """Runs of short lines that compress like closings, at least half of them verified; a line alone only if it
    is known to stand alone, is nothing but a contact, or is of four words and ends what is newly written."""
    n, i = len(lines), 0
    d = model.of["signature"]
    while i < n:
        if not _open(lines, kind, i):
            i += 1
            continue
        if flat:
            p = plain(lines[i])
            head = p[:BLOCK_CHARS]
            begins = _RULER.match(head.split(" ")[0]) is not None or any(head.startswith(o) for o in model.openers | model.lone if not _RULER.match(o)) or re.match(r"\[REDACTED_PERSON\].*\[REDACTED_(?:PHONE|EMAIL)\]", head)
            first = next((o for o in sorted(model.openers, key=len, reverse=True) if head.startswith(o) and not _RULER.match(o)), head.split(" ")[0] if _RULER.match(head.split(" ")[0]) else "")
            if first and (name := _TWO_NAMES.match(head, len(first))):  # a name that no dictionary knows
                head = f"{first} [REDACTED_PERSON]{head[name.end() :]}"
            if i and begins and model.suspected(head, "signature"):
                kind[i] = "signature"
            i += 1
            continue
        end = i
        while end < n and end - i < BLOCK_LINES and _open(lines, kind, end) and _short(lines[end]):
            end += 1
        opener = plain(lines[i]) in model.openers or _RULER.match(lines[i]) is not None
        if opener and end == i + 1 and end + 1 < n and not lines[end] and _open(lines, kind, end + 1):  # a blank line below the closing words
            end += 1
            while end < n and end - i < BLOCK_LINES and _open(lines, kind, end) and _short(lines[end]):
                end += 1
        if end == i:
            i += 1
            continue
        body = [plain(x) for x in lines[i:end] if x]
        if len(body) == 1:
            last = i > 0 and not any(_open(lines, kind, k) for k in range(end, n)) and len(_TOKEN.findall(body[0])) >= 4
            ok = (body[0] in model.lone or _CONTACT.match(body[0]) is not None or last and model.verified(body[0], "signature", OVERLAP)) and model.suspected(body[0], "signature")
        else:
            met = sum(_RULER.match(x) is not None or _CONTACT.match(x) is not None or d.overlap(x) >= OVERLAP for x in body)
            named = any(x.startswith("[REDACTED_") or _CONTACT.match(x) for x in body)
            ok = met * 2 >= len(body) and (named or met > 1) and not (len(body) == 2 and opener and not named and body[1] not in d) and model.suspected("\n".join(body), "signature")
        if ok:
            kind[i:end] = ["signature" if lines[k] else None for k in range(i, end)]
            i = end
        else:
            i += 1 if len(body) > 1 and not opener else max(1, end - i)


def newly_written(text: str | None, model: MailModel) -> str | None:
    """The text without its foreign parts and the blank lines they leave; null stays null."""
    if text is None:
        return None
    out, at = [], 0
    for s in foreign(text, model):
        out.append(text[at : s.start])
        at = s.end
    return re.sub(r"\n{3,}", "\n\n", "".join([*out, text[at:]])).strip() if at else text


# --- over tables ---------------------------------------------------------------------------


LINE = "kind string, line string, mails bigint, opener boolean, lone boolean"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    types = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}
    names = [x.split(" ") for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[t]) for i, (_, t) in enumerate(names)], [n for n, _ in names])


def fit_mails(mails: DataFrame, text: str) -> MailModel:
    """Dictionaries from all the mails, each distinct text once, of all lines that stand in ``LEAST`` mails. Lines are
    counted where the mails lie and only lines and their counts move; the driver gets ``HELD_BYTES`` of them, or where
    there are more the pages, and the lines behind them stay a table."""
    one = mails.select(F.col(text).alias("t")).where(F.length("t") > 0).distinct()
    schema = "unit string, " + ", ".join(f"{r} bigint" for r in ROLES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, size = {}, 0
        for b in (part for batch in batches for part in by_bytes(batch, 0)):
            for u, c in _count(b.column(0).to_pylist()).items():
                known = counts.get(u)
                counts[u] = [x + y for x, y in zip(known, c)] if known else c
                size += 0 if known else len(u)
            if len(counts) > 200_000 or size > 32 << 20:
                yield _batch([(u, *c) for u, c in counts.items()], schema)
                counts, size = {}, 0
        yield _batch([(u, *c) for u, c in counts.items()], schema)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in by_bytes(batch, 0)):
            yield _batch([x for row in zip(*(c.to_pylist() for c in b.columns)) for x in _lines(*row)], LINE)

    units = one.mapInArrow(run, schema.replace("all bigint", "`all` bigint")).groupBy("unit").agg(*[F.sum(r).alias(r) for r in ROLES]).where(F.col("all") >= LEAST)
    kept = cut(units.mapInArrow(lines, LINE), "lines")
    if (kept.df.agg(F.sum(F.octet_length("line") + 1)).first()[0] or 0) <= HELD_BYTES:
        rows = [tuple(r) for r in kept.df.collect()]
        kept.drop()
        return MailModel.of_lines(rows)
    first: list[tuple] = []
    for k in KINDS:  # a page has no more lines than that, and none longer
        top = kept.df.where(F.col("kind") == k).orderBy(F.desc("mails"), "line").limit(DICTIONARY_BYTES // 2)
        rows = [tuple(r) for r in top.collect()]
        page = Dictionary([mask(x) for x in SEEDS[k].split("\n")] + [r[1] for r in rows]).page
        first += [r for r in rows if r[1] in page]
    model = MailModel.of_lines(first)
    pages = {k: model.of[k].page for k in KINDS}

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1_000):
                rows = zip(*(c.to_pylist() for c in b.slice(lo, 1_000).columns))
                yield _batch([(key, group, *r) for r in rows if r[1] not in pages[r[0]] for key, group in _line_keys(*r)], f"key bigint, group string, {LINE}")

    # Of the lines that have a triple the most usual stands for all.
    best = F.min(F.struct((-F.col("mails")).alias("m"), "line", "opener", "lone")).alias("b")
    near = cut(kept.df.mapInArrow(keyed, f"key bigint, group string, {LINE}").groupBy("key", "kind", "group").agg(best).select("key", "kind", "b.line", (-F.col("b.m")).alias("mails"), "b.opener", "b.lone").distinct(), "near")
    kept.drop()
    model.behind = near.df
    return model


_words: dict[str, int] = {}


def _word(w: str) -> int:
    h = _words.get(w)
    if h is None:
        h = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "replace"), digest_size=8).digest(), "little")
        if len(_words) > 200_000:
            _words.clear()
        _words[w] = h
    return h


def _window_keys(words: list[str], sizes: Iterable[int]) -> np.ndarray:
    """A key of each run of so many words."""
    h = np.array([_word(w) for w in words], np.uint64)
    out = [np.empty(0, np.uint64)]
    for k in sizes:
        if k <= len(h):
            x = np.full(len(h) - k + 1, k, np.uint64)
            for i in range(k):
                x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i]
            out.append(x)
    return np.concatenate(out).view(np.int64)


def _line_keys(kind: str, line: str, mails: int, opener: bool, lone: bool) -> list[tuple[int, str]]:
    """``(key, group)`` under which mails find a line: its triples; a closing line whole; what it begins with."""
    words = _TOKEN.findall(line.lower())
    keys = [(k, "") for k in set(_window_keys(words, (min(3, len(words)),)).tolist())] if words else []
    if kind == "signature":
        keys.append((_whole_key(line), "whole"))
    for what, x in _starts(kind, line, opener, lone):
        start = _TOKEN.findall(x.lower())[:3]
        keys.append((_window_keys(start, (len(start),)).tolist()[0] if start else 0, f"{what} {x}"))
    return keys


def _whole_key(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode("utf-8", "replace"), digest_size=8, person=b"line").digest(), "little", signed=True)


def mail_keys(text: str) -> np.ndarray:
    """The keys of all lines that may bear upon a mail."""
    _, lines = _split_lines(text)
    keys = [np.zeros(1, np.int64), _window_keys(_TOKEN.findall(_mask_digits.sub("0", text).lower()), (1, 2, 3))]
    masked = {p for line in lines if line and (p := plain(line)) != mask(line)}
    for a, b in zip(lines, lines[1:]):
        if b.endswith((":", "-")) and len(a) + len(b) < INTRO_CHARS:
            masked.add(plain(f"{a} {b}"))
    if len(lines) == 1 or "\n" not in text.strip():
        masked |= {plain(text), _TWO_NAMES.sub(" [REDACTED_PERSON]", plain(text)), "[REDACTED_PERSON]"}
    keys += [_window_keys(_TOKEN.findall(p.lower()), (1, 2, 3)) for p in masked]
    keys.append(np.array([_whole_key(plain(line)) for line in lines if 0 < len(line) <= BLOCK_CHARS], np.int64))
    return np.unique(np.concatenate(keys))


def _with_lines(df: DataFrame, key: str, text: str, model: MailModel) -> DataFrame:
    """``(k, t)``, and where lines lie behind the pages those that share words with the text."""
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    if model.behind is None:
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in by_bytes(batch, 1, 1 << 20)):
            keys = [mail_keys(t) for t in b.column(1).to_pylist()]
            at = np.repeat(np.arange(len(keys), dtype=np.int32), [len(x) for x in keys])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(np.concatenate(keys))], ["m", "key"])

    mails = rows.where(F.length("t") > 0).select(F.xxhash64("t").alias("m"), "t").distinct()
    line = F.struct("kind", "line", "mails", "opener", "lone")
    near = mails.mapInArrow(run, "m bigint, key bigint").join(model.behind, "key").groupBy("m").agg(F.collect_set(line).alias("near"))
    return rows.withColumn("m", F.xxhash64("t")).join(near, "m", "left").select("k", "t", "near")


def _models(b: pa.RecordBatch, model: MailModel) -> Iterator[tuple[str | None, MailModel]]:
    """Each text of a batch with the model for it."""
    if b.num_columns < 3:
        for t in b.column(1).to_pylist():
            yield t, model
        return
    for t, near in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
        yield t, model.with_lines([tuple(r.values()) for r in near]) if near else model


def is_mail(source):
    return kind_key(source) == "msgraph_email"


def parts(df: DataFrame, key: str, text: str, model: MailModel) -> DataFrame:
    """``(key, foreign_part)``: each kind of foreign part in each row's text once. Rows without any have
    no row; keys may be null or repeated; other columns are not read; an empty table gives an empty one."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # HELD_BYTES of lines at most
    t = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in by_bytes(batch, 1)):
            at, found = [], []
            for i, (x, m) in enumerate(_models(b, shared.value)):
                for k in sorted({s.kind for s in foreign(x, m)}):
                    at.append(i)
                    found.append(k)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), pa.array(found, pa.string())], ["k", "foreign_part"])

    return _with_lines(df, key, text, model).mapInArrow(run, f"k {t.simpleString()}, foreign_part string").withColumnRenamed("k", key)


def reduce(df: DataFrame, key: str, text: str, model: MailModel) -> DataFrame:
    """``(key, new_text)`` of every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    t = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in by_bytes(batch, 1)):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([newly_written(x, m) for x, m in _models(b, shared.value)], pa.string())], ["k", "new_text"])

    return _with_lines(df, key, text, model).mapInArrow(run, f"k {t.simpleString()}, new_text string").withColumnRenamed("k", key)
