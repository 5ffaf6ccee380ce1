"""Made-up entities in place of real ones: keyed, of the same type, gender, script and format.

An entity is taken apart into what is constant (titles, street words, separators, country codes) and parts of a
class: given names, family names, words of places, of addresses of mail and of domains, and numbers. Each part
gets a keyed surrogate of its class, the same wherever it occurs, so that ``John Smith``, ``Dr. Smith`` and ``J. Smith``
stay one person: surrogates of names that begin with one letter begin with one letter. Then the entity is put
together again in the writing of its mention. ``assign`` checks all parts of the corpus: no two of a class share a
surrogate, and none is a real part of that class. Words grow with every attempt, so there is always room.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from math import gcd, log
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.llm.common import cut

# --- gender --------------------------------------------------------------------------------

# Common given names of several countries, on which the gender of names is fitted.
FEMALE = """mary patricia jennifer linda elizabeth barbara susan jessica sarah karen lisa nancy sandra ashley emily kimberly margaret donna michelle carol amanda melissa deborah stephanie
rebecca sharon laura cynthia amy kathleen angela helen anna ruth marie claire camille juliette sophie isabelle nathalie chantal monique heike ingrid ursula sabine katrin olena oksana iryna
natalia svitlana yuki sakura aiko maria carmen lucia elena sofia paula ines""".split()
MALE = """james robert john michael david william richard joseph thomas christopher charles daniel matthew anthony mark donald steven andrew paul joshua kenneth kevin brian timothy ronald george
jason edward jeffrey ryan jacob nicholas gary eric jonathan stephen larry henry frank scott pierre jean louis antoine benoit julien laurent thierry klaus juergen dieter wolfgang stefan oleksandr
mykola andriy serhiy ivan hiroshi kenji takashi carlos jose luis miguel pedro diego""".split()  # fmt: skip
# Latin letters for Cyrillic ones, by which the endings of names are judged.
CYRILLIC = dict(zip("абвгґдеєжзиіїйклмнопрстуфхцчшщьюя", ["a", "b", "v", "h", "g", "d", "e", "ie", "zh", "z", "y", "i", "i", "i", "k", "l", "m", "n", "o", "p", "r", "s", "t", "u", "f", "kh", "ts", "ch", "sh", "shch", "", "iu", "ia"]))


def _plain(w: str) -> str:
    w = "".join(CYRILLIC.get(c, c) for c in w.lower())
    return "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c))


class Gender:
    """Whether a given name is a woman's, by the known names, else by the endings that they have."""

    def __init__(self, female: list[str] = FEMALE, male: list[str] = MALE):
        self.known = {_plain(n): True for n in female} | {_plain(n): False for n in male}
        ends = {True: Counter(), False: Counter()}
        for n, g in self.known.items():
            ends[g].update(n[-k:] for k in (1, 2))
        both = ends[True] | ends[False]
        self.weight = {e: log((ends[True][e] + 1) / (len(female) + 2)) - log((ends[False][e] + 1) / (len(male) + 2)) for e in both}

    def is_female(self, name: str) -> bool:
        n = _plain(name)
        known = self.known.get(n)
        return known if known is not None else sum(self.weight.get(n[-k:], 0.0) for k in (1, 2)) > 0


GENDER = Gender()

# --- keyed derivation ----------------------------------------------------------------------


class Dice:
    """Numbers derived from a key and what it is for."""

    def __init__(self, key: bytes, *of: object):
        self.key, self.of, self.n = key, "\x00".join(map(str, of)).encode(), 0
        self.pool = 0
        self.left = 1

    def roll(self, sides: int) -> int:
        if self.left < sides << 32:
            h = hmac.new(self.key, self.of + self.n.to_bytes(4, "big"), hashlib.sha256).digest()
            self.pool, self.left, self.n = int.from_bytes(h, "big"), 1 << 256, self.n + 1
        out = self.pool % sides
        self.pool //= sides
        self.left //= sides
        return out

    def pick(self, items):
        return items[self.roll(len(items))]


def _permuted(key: bytes, what: str, alphabet: str) -> dict[str, str]:
    dice, rest = Dice(key, "letters", what, alphabet), list(alphabet)
    for i in range(len(rest) - 1, 0, -1):
        j = dice.roll(i + 1)
        rest[i], rest[j] = rest[j], rest[i]
    return dict(zip(alphabet, rest))


class Script(NamedTuple):
    name: str
    vowels: str
    consonants: str
    female: tuple[str, ...]
    male: tuple[str, ...]
    family: tuple[str, ...]


LATIN = Script("latin", "aeiou", "bcdfghjklmnpqrstvwxyz", ("ara", "ina", "elle", "ette", "ia", "aline"), ("an", "or", "ert", "ik", "on", "ard"), ("son", "ley", "mont", "wick", "berg", "ard", "ster"))
CYRILLIC_SCRIPT = Script("cyrillic", "аеиоу", "бвгджзклмнпрстфхцчш", ("ина", "ана", "ія"), ("ан", "ор", "ій"), ("енко", "чук", "ський", "ук"))
GREEK = Script("greek", "αειου", "βγδζθκλμνξπρστφχψ", ("ια", "ίνα", "ούλα"), ("ος", "ης", "ας"), ("ίδης", "άκης", "όπουλος"))
# Scripts without case: a name is as many characters as it was, from the usual ones.
BLOCKS = {"kana": (0x3042, 0x3093), "katakana": (0x30A2, 0x30F3), "han": (0x4E00, 0x7000), "hangul": (0xAC00, 0xD7A3), "arabic": (0x0628, 0x064A), "hebrew": (0x05D0, 0x05EA)}


def script_of(w: str) -> str:
    for c in w:
        name = unicodedata.name(c, "")
        for s, mark in (("latin", "LATIN"), ("cyrillic", "CYRILLIC"), ("greek", "GREEK"), ("kana", "HIRAGANA"), ("katakana", "KATAKANA"), ("han", "CJK"), ("hangul", "HANGUL"), ("arabic", "ARABIC"), ("hebrew", "HEBREW")):
            if name.startswith(mark):
                return s
    return "latin"


_SCRIPTS = {"latin": LATIN, "cyrillic": CYRILLIC_SCRIPT, "greek": GREEK}
_letters: dict[tuple[bytes, str], dict[str, str]] = {}


def initial(key: bytes, cls: str, letter: str) -> str:
    """The first letter of all surrogates of names of a class that begin with ``letter``; one letter for one."""
    s = _SCRIPTS.get(script_of(letter))
    base = unicodedata.normalize("NFD", letter.lower())[0]
    if s is None or base not in s.vowels + s.consonants:
        return base
    k = (key, cls + s.name)
    if k not in _letters:
        _letters[k] = _permuted(key, cls, s.vowels + s.consonants)
    return _letters[k][base]


def _name(dice: Dice, s: Script, first: str, ends: tuple[str, ...], syllables: int) -> str:
    out = first
    for _ in range(syllables):
        out += (dice.pick(s.vowels) if out[-1] in s.consonants else "") + dice.pick(s.consonants)
    end = dice.pick(ends)
    if out[-1] in s.consonants and end[0] in s.consonants:
        out += dice.pick(s.vowels)
    return out + end


def part_surrogate(cls: str, part: str, key: bytes, attempt: int = 0) -> str:
    """The surrogate of a part; another one at each attempt, and of words a longer one at every fourth."""
    dice = Dice(key, cls, part, attempt)
    if cls in ("given", "family", "place", "mail", "domain"):
        script = script_of(part)
        if script in BLOCKS:
            lo, hi = BLOCKS[script]
            return "".join(chr(lo + dice.roll(hi - lo)) for _ in range(len(part) + attempt // 4))
        s = _SCRIPTS[script]
        more = attempt // 4
        if cls == "given":
            female = GENDER.is_female(part)
            for _ in range(16):
                name = _name(dice, s, initial(key, cls, part[0]), s.female if female else s.male, 1 + more + dice.roll(2))
                if GENDER.is_female(name) == female:
                    break
            return name
        if cls == "family":
            return _name(dice, s, initial(key, cls, part[0]), s.family, 1 + more + dice.roll(2))
        return _name(dice, s, dice.pick(s.consonants), s.family if cls == "place" else (dice.pick(s.vowels) + dice.pick(s.consonants),), 1 + more + dice.roll(2))
    if cls == "phone":
        code, number = part.split("|")
        if code == "1" and len(number) == 10:
            while True:  # area code and exchange begin with 2 to 9 and are no service codes
                n = "".join([str(2 + dice.roll(8)), *(str(dice.roll(10)) for _ in range(2)), str(2 + dice.roll(8)), *(str(dice.roll(10)) for _ in range(6))])
                if n[1:3] != "11" and n[4:6] != "11" and n[1] != "9":
                    return f"{code}|{n}"
        keep = len(number) - len(number.lstrip("0"))
        keep += keep < len(number)  # the leading zeros and the digit that tells the kind of number
        return f"{code}|{number[:keep]}" + "".join(str(dice.roll(10)) for _ in range(len(number) - keep))
    if cls in ("sin", "cc"):
        keep = 1 if cls == "sin" else 2  # region and brand
        body = part[:keep] + "".join(str(dice.roll(10)) for _ in range(len(part) - keep - 1))
        return body + next(str(c) for c in range(10) if luhn(body + str(c)))
    if ":" in part:
        return "2001:db8:" + ":".join(f"{dice.roll(65536):x}" for _ in range(6))
    a, b, *_ = map(int, part.split("."))
    if a == 10 or (a, b) == (192, 168) or a == 172 and 16 <= b < 32:
        head = [10] if a == 10 else [a, b]
    else:
        head = [198, 18 + dice.roll(2)] if attempt < 4 else [198 + dice.roll(2), dice.roll(256)]
    return ".".join(map(str, head + [dice.roll(254) + 1 for _ in range(4 - len(head))]))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = (ord(c) - 48) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


# --- taking apart and putting together -----------------------------------------------------


class Piece(NamedTuple):
    """Constant text, or a part of a class; ``shape`` is what it was written like."""

    text: str
    cls: str = ""
    shape: str = ""


_TITLES = {"dr", "mr", "mrs", "ms", "mme", "prof"}
_MAIL_WORDS = {"at", "arobase", "arobas", "dot", "point", "underscore", "dash", "hyphen", "plus", "tiret"}
RESERVED = {"example", "test", "invalid", "localhost"}
# Digits in words.
DIGITS_EN = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]
DIGITS_FR = ["zéro", "un", "deux", "trois", "quatre", "cinq", "six", "sept", "huit", "neuf"]
# Numbers in words, and other words of addresses that are no names.
UNITS, TEENS, TENS = DIGITS_EN[1:], ["ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen"], ["twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]
ADDRESS_WORDS = set(
    """street st avenue ave road rd crescent cres lane ln drive dr boulevard blvd court ct place pl square terrace way rue boul chemin allée impasse quai suite unit apt apartment bureau app
    in à de la des du d l le les bis ter hundred and north south east west nord sud est ouest straße strasse str gasse platz allee""".split()
)
_GERMAN = re.compile(r"^(.+?)(straße|strasse|str|gasse|platz|allee)$", re.I)
# Fixed rule: calling codes of one and two digits; all others have three.
_TWO = {"20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", *map(str, range(51, 59)), *map(str, range(60, 67)), "81", "82", "84", "86", *map(str, range(90, 96)), "98"}


def calling_code(digits: str) -> str:
    return digits[0] if digits[0] in "17" else digits[:2] if digits[:2] in _TWO else digits[:3]


def take_apart(kind: str, raw: str, is_given: Callable[[str], bool], spoken: Callable[[str], str]) -> list[Piece]:
    """The pieces of a mention; the texts of the constant ones and the shapes of the others give it again."""
    if kind in ("phone", "sin", "cc"):
        digits = re.sub(r"\D", "", raw) or spoken(raw)
        if kind != "phone":
            return [Piece(digits, kind, raw)]
        if "+" in raw or raw.lower().startswith("plus"):
            code = calling_code(digits)
        else:
            code = "1" if len(digits) in (10, 7) or len(digits) == 11 and digits[0] == "1" else ""
        number = digits[len(code) :] if len(digits) not in (10, 7) or "+" in raw else digits
        return [Piece(f"{code}|{number}", "phone", raw)]
    if kind == "ip":
        return [Piece(raw.lower(), "ip", raw)]
    out: list[Piece] = []
    at = 0
    tokens = list(re.finditer(r"[^\W_]+" if kind == "email" else r"[^\W\d_]+|\d+", raw))
    words = [m for m in tokens if m[0].lower() not in _TITLES] if kind == "person" else tokens
    if kind == "email":
        signs = "@" in raw or "＠" in raw
        where = max(raw.find("@"), raw.find("＠"))
        if not signs:
            where = max((m.start() for m in tokens if m[0].lower() in ("at", "arobase", "arobas")), default=len(raw))
    comma = raw.find(",") if kind == "person" else -1
    for n, m in enumerate(tokens):
        w = m[0]
        low = w.lower()
        out.append(Piece(raw[at : m.start()]))
        at = m.end()
        if kind == "email":
            if not signs and low in _MAIL_WORDS:
                out.append(Piece(w))
            elif m.start() < where:
                out.append(Piece(low, "mail", w))
            elif n + 1 == len(tokens):
                out.append(Piece(w if low in RESERVED else "EXAMPLE" if w.isupper() else "example", "", w))
            else:
                out.append(Piece(low, "domain", w))
        elif kind == "address":
            german = _GERMAN.match(low)
            if low.isdigit():
                out.append(Piece(low, "number", w))
            elif low in UNITS or low in TEENS or low in TENS:
                out.append(Piece(low, "spelt", w))
            elif low in ADDRESS_WORDS or len(w) == 1:
                out.append(Piece(w))
            elif german:
                k = len(german[1])
                out += [Piece(low[:k], "place", w[:k]), Piece(w[k:])]
            else:
                out.append(Piece(low, "place", w))
        elif low in _TITLES or w.isdigit():
            out.append(Piece(w))
        else:
            k = words.index(m)
            if comma >= 0:
                cls = "family" if m.end() <= comma else "given"
            elif len(words) == 1:
                cls = "given" if is_given(w) else "family"
            else:
                cls = "family" if k + 1 == len(words) else "given"
            out.append(Piece(low, cls + "_initial" if len(w) == 1 else cls, w))
    out.append(Piece(raw[at:]))
    return [p for p in out if p.text]


def parts_of(pieces: list[Piece]) -> list[tuple[str, str]]:
    """The parts that get a surrogate of their own."""
    return [(p.cls, p.text) for p in pieces if p.cls and p.cls not in ("number", "spelt") and not p.cls.endswith("_initial")]


def _cased(new: str, shape: str) -> str:
    return new.upper() if shape.isupper() and len(shape) > 1 else new.lower() if shape.islower() else new[:1].upper() + new[1:]


def put_together(pieces: list[Piece], given: dict[tuple[str, str], str], key: bytes) -> str:
    """The mention with the surrogates of its parts."""
    out = []
    for p in pieces:
        if not p.cls:
            out.append(p.text)
        elif p.cls.endswith("_initial"):
            new = initial(key, p.cls[: -len("_initial")], p.text)
            out.append(new.upper() if p.shape.isupper() else new)
        elif p.cls == "number":
            lo, hi = (0, 10) if len(p.text) == 1 else (10 ** (len(p.text) - 1), 10 ** len(p.text))
            if not lo <= int(p.text) < hi:  # leading zeros
                lo, hi = 0, 10 ** len(p.text)
            dice, span = Dice(key, "number", len(p.text), lo), hi - lo
            while gcd(a := 3 + 2 * dice.roll(span), span) != 1:
                pass
            out.append(str((a * (int(p.text) - lo) + 1 + dice.roll(span - 1)) % span + lo).zfill(len(p.text)))
        elif p.cls == "spelt":
            words = next(ws for ws in (UNITS, TEENS, TENS) if p.text in ws)
            out.append(_cased(words[(words.index(p.text) + 1 + Dice(key, "spelt", len(words)).roll(len(words) - 1)) % len(words)], p.shape))
        elif p.cls in ("phone", "sin", "cc"):
            new = given[p.cls, p.text].replace("|", "")
            if not re.search(r"\d", p.shape):  # spoken: digit by digit, in its language
                fr = any(w in DIGITS_FR and w != "six" for w in re.findall(r"[^\W\d_]+", p.shape.lower()))
                said = " ".join((DIGITS_FR if fr else DIGITS_EN)[int(c)] for c in new[-len(p.text.split("|")[-1]) :])
                head = "plus " + " ".join((DIGITS_FR if fr else DIGITS_EN)[int(c)] for c in p.text.split("|")[0]) + " " if p.shape.lower().startswith("plus") else ""
                out.append(_cased(head + said, p.shape) if p.shape.islower() or p.shape.isupper() else head + said)
            else:
                digits = iter(new[-sum(c.isdigit() for c in p.shape) :])
                out.append("".join(next(digits) if c.isdigit() else c for c in p.shape))
        elif p.cls == "ip":
            out.append(given[p.cls, p.text])
        else:
            out.append(_cased(given[p.cls, p.text], p.shape))
    return "".join(out)


# --- over tables ---------------------------------------------------------------------------


FEW_PARTS = 200_000
"""So many parts get their surrogates in one task; more take rounds over the cluster, with the same result."""


def assign(parts: DataFrame, key: bytes, few: int = FEW_PARTS) -> DataFrame:
    """``(cls, part, s)``: of each distinct part ``(cls, part)`` its surrogate, no other part's and no real part's.

    Parts whose surrogates meet keep the one of the smallest attempt and part; the others, and those that met a real
    part, derive again. Words grow and numbers have far more forms than a corpus has entities, so the rounds end.
    """
    real = cut(parts.select("cls", "part").distinct(), "parts")

    def derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [part_surrogate(c, p, key, a) for c, p, a in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string())], ["cls", "part", "attempt", "s"])

    def at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = sorted({(c, p) for b in batches for c, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())})
        made = settled(every, key)
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in every], pa.string()), pa.array([x[1] for x in every], pa.string()), pa.array([made[x] for x in every], pa.string())], ["cls", "part", "s"])

    if real.df.count() <= few:
        return real.df.coalesce(1).mapInArrow(at_once, "cls string, part string, s string")
    schema = "cls string, part string, attempt int, s string"
    table = cut(real.df.withColumn("attempt", F.lit(0)).mapInArrow(derive, schema), "surrogates")
    taken = real.df.select("cls", F.col("part").alias("s"), F.lit(True).alias("taken"))
    while True:
        # Two parts rarely meet, so the groups of this window are few rows each.
        w = Window.partitionBy("cls", "s").orderBy("attempt", "part")
        judged = table.df.withColumn("n", F.row_number().over(w)).join(taken, ["cls", "s"], "left")
        again = judged.where((F.col("n") > 1) | F.col("taken")).select("cls", "part", (F.col("attempt") + 1).alias("attempt"))
        todo = cut(again, "again")
        if not todo.df.limit(1).count():
            todo.drop()
            real.drop()
            return table.df.select("cls", "part", "s")
        kept = table.df.join(todo.df.select("cls", "part"), ["cls", "part"], "left_anti")
        new = cut(kept.unionByName(todo.df.mapInArrow(derive, schema)), "surrogates")
        table.drop()
        todo.drop()
        table = new


def settled(parts: list[tuple[str, str]], key: bytes) -> dict[tuple[str, str], str]:
    """The surrogates of all these parts, round by round as over a table."""
    real = set(parts)
    attempt = dict.fromkeys(parts, 0)
    made = {x: part_surrogate(*x, key) for x in parts}
    while True:
        holder: dict[tuple[str, str], tuple[int, str]] = {}
        for (cls, part), s in made.items():
            mine = (attempt[cls, part], part)
            holder[cls, s] = min(holder.get((cls, s), mine), mine)
        again = [x for x in parts if (x[0], made[x]) in real or holder[x[0], made[x]][1] != x[1]]
        if not again:
            return made
        for x in again:
            attempt[x] += 1
            made[x] = part_surrogate(*x, key, attempt[x])


def of_mentions(found: DataFrame, key: bytes, is_given: Callable[[], Callable[[str], bool]], spoken: Callable[[str], str]) -> DataFrame:
    """``(kind, raw, surrogate)`` of each distinct ``(kind, raw)`` of ``found``. ``is_given`` gives, on a worker, what
    tells whether a name that stands alone is a given name."""
    pair = pa.struct([("cls", pa.string()), ("part", pa.string())])

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tells = is_given()
        for b in batches:
            ps = [[{"cls": c, "part": p} for c, p in parts_of(take_apart(k, r, tells, spoken))] for k, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ps, pa.list_(pair))], ["kind", "raw", "parts"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tells = is_given()
        for b in batches:
            made = []
            for k, r, ps in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                made.append(put_together(take_apart(k, r, tells, spoken), {(x["cls"], x["part"]): x["s"] for x in ps or ()}, key))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.string())], ["kind", "raw", "surrogate"])

    forms = cut(found.select("kind", "raw").distinct().mapInArrow(apart, "kind string, raw string, parts array<struct<cls string, part string>>"), "forms").df
    each = forms.select("kind", "raw", F.explode("parts").alias("p")).select("kind", "raw", "p.cls", "p.part")
    chosen = assign(each, key)
    # As many rows as a mention has words.
    got = each.join(chosen, ["cls", "part"]).groupBy("kind", "raw").agg(F.collect_set(F.struct("cls", "part", "s")).alias("parts"))
    bare = forms.where(F.size("parts") == 0).select("kind", "raw", F.array().cast("array<struct<cls string, part string, s string>>").alias("parts"))
    return got.unionByName(bare).mapInArrow(together, "kind string, raw string, surrogate string")
