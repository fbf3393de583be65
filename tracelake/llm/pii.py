"""Personal data: validated values give way to keyed pseudonyms of the same format.

Kinds: e-mail addresses, phone numbers, payment cards (Luhn), IBANs (mod 97), social security numbers
(valid ranges), IPv4 addresses, calendar dates (in figures, or with the month's English name). A value that
fails its validation stays as it is.

A value is a number below the count of all values of its format; a Feistel network keyed for the kind
permutes these numbers (steps outside the range are walked on), and check digits are computed anew. Where
a format has few values the permutation is one cycle, so that no value stays. A pseudonym is valid in its
format, equal values get equal pseudonyms in all documents, and who holds the key can undo it.

Of e-mail addresses the local part and the domain without its last label change, each for itself, so that
equal domains stay linked. Dates change within those whose day and month have the same numbers of digits
and are read alike (1-9, 10-12, over 12), so every layout is undone exactly and a date is the same day in
all layouts.

The key is a setting of the session (KEY_SETTING); where it is unset, each application draws its own, and
its pseudonyms can't be undone or linked to those of another.

Null text stays null, empty text empty; rows that repeat change alike; other columns stay as they are.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import secrets as stdlib_secrets
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.tokens import slices

ROUNDS = 10
FEW = 1 << 16  # formats of fewer values are permuted in one cycle
REMEMBERED = 100_000  # pseudonyms, and permutations, that a task keeps
KEY_SETTING = "spark.tracelake.pii.secret"
_own_keys: dict[str, str] = {}


def session_key(spark: SparkSession) -> str:
    """The session's key, else one drawn for this application."""
    return spark.conf.get(KEY_SETTING, None) or _own_keys.setdefault(spark.sparkContext.applicationId, stdlib_secrets.token_hex(32))


class Permutation:
    """A keyed permutation of range(size): a Feistel network on an even number of bits, walked until
    the result is in range again."""

    def __init__(self, key: str, kind: str, size: int):
        self.size, self.half = size, max(1, ((size - 1).bit_length() + 1) // 2)
        self.keys = [hashlib.blake2b(f"{kind}:{size}:{i}".encode(), key=hashlib.sha256(key.encode()).digest()).digest()[:32] for i in range(ROUNDS)]

    def _round(self, i: int, x: int) -> int:
        data = x.to_bytes(self.half // 8 + 1, "big")
        return int.from_bytes(hashlib.blake2b(data, key=self.keys[i], digest_size=min(64, self.half // 8 + 1)).digest(), "big") & ((1 << self.half) - 1)

    def _pass(self, x: int, order) -> int:
        left, right = x >> self.half, x & ((1 << self.half) - 1)
        for i in order:
            left, right = right, left ^ self._round(i, right)
        return right << self.half | left  # halves change places, so the rounds in reverse undo it

    def apply(self, x: int, undo: bool = False) -> int:
        order = range(ROUNDS - 1, -1, -1) if undo else range(ROUNDS)
        x = self._pass(x, order)
        while x >= self.size:
            x = self._pass(x, order)
        return x


#: Alphabets in which a character is exchanged; see alphabet() for those of other scripts.
ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ")


@lru_cache(1)
def other_alphabets() -> dict[str, tuple[str, list[str]]]:
    """For letters and digits outside ALPHABETS: the name and the characters of their alphabet, which are
    those of the same script (the first word of their names) and category."""
    sets: dict[str, list[str]] = {}
    for c in map(chr, range(128, 0x110000)):
        if c.isalnum() and not any(c in a for a in ALPHABETS):
            sets.setdefault(f"<{unicodedata.name(c, '?').split()[0]} {unicodedata.category(c)}>", []).append(c)
    return {c: (name, a) for name, a in sets.items() for c in a}


@lru_cache(10_000)
def alphabet(c: str) -> tuple[str, str | list[str]]:
    for i, a in enumerate(ALPHABETS):
        if c in a:
            return str(i), a
    name, a = other_alphabets().get(c, (".", c)) if c > "\x7f" else (".", c)
    return (name, a) if len(a) > 1 else (".", c)


class Pseudonyms:
    """Pseudonyms under one key."""

    def __init__(self, key: str, undo: bool = False):
        if not key:
            raise ValueError("pseudonyms need a key")
        self.key, self.undo, self.made, self.known = key, undo, {}, {}

    def of(self, kind: str, value: str) -> str:
        """The pseudonym of a value of this kind."""
        if (kind, value) not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[kind, value] = getattr(self, kind)(value)
        return self.known[kind, value]

    def number(self, kind: str, size: int, x: int) -> int:
        if (kind, size) not in self.made:
            if len(self.made) >= REMEMBERED:
                self.made.clear()
            self.made[kind, size] = Permutation(self.key, kind, size)
        if size >= FEW:
            return self.made[kind, size].apply(x, self.undo)
        cycle = self.made[kind, size]
        return cycle.apply((cycle.apply(x) + (-1 if self.undo else 1)) % size, undo=True)

    def characters(self, kind: str, value: str) -> str:
        """Each digit and letter becomes one of its alphabet; all of them are permuted as one number."""
        names, sets = zip(*map(alphabet, value)) if value else ((), ())
        size, x = 1, 0
        for c, a in zip(value, sets):
            x, size = x * len(a) + a.index(c), size * len(a)
        x, out = self.number(kind + "".join(names), size, x), []
        for a in reversed(sets):
            x, k = divmod(x, len(a))
            out.append(a[k])
        return "".join(reversed(out))

    def email(self, value: str) -> str:
        local, _, domain = value.partition("@")
        names, dot, last = domain.rpartition(".")
        return f"{self.characters('email', local)}@{self.characters('domain', names)}{dot}{last}"

    def phone(self, value: str) -> str:
        """The digits behind a country code change; without a known one, the last ten."""
        digits = [i for i, c in enumerate(value) if c.isdigit()]
        code = country_code("".join(value[i] for i in digits)) if value[0] == "+" else ""
        national = digits[len(code) :]
        digits = national if code and (code != "1" or len(national) == 10) else digits[-10:]
        return put(value, digits, self.characters("phone", "".join(value[i] for i in digits)))

    def card(self, value: str) -> str:
        digits = [i for i, c in enumerate(value) if c.isdigit()]
        body = self.characters("card", "".join(value[i] for i in digits[:-1]))
        return put(value, digits, body + next(c for c in "0123456789" if luhn(body + c)))

    def ip(self, value: str) -> str:
        a, b, c, d = map(int, value.split("."))
        return ".".join(map(str, self.number("ip", 1 << 32, a << 24 | b << 16 | c << 8 | d).to_bytes(4, "big")))

    def ssn(self, value: str) -> str:
        areas = [*range(1, 666), *range(667, 900)]
        a, b, c = map(int, value.split("-"))
        x = self.number("ssn", 898 * 99 * 9999, (areas.index(a) * 99 + b - 1) * 9999 + c - 1)
        return f"{areas[x // 9999 // 99]:03d}-{x // 9999 % 99 + 1:02d}-{x % 9999 + 1:04d}"

    def iban(self, value: str) -> str:
        at = [i for i, c in enumerate(value) if c.isalnum()]
        plain = "".join(value[i] for i in at)
        body = self.characters("iban", plain[4:])
        return put(value, at, plain[:2] + f"{98 - mod97(body + plain[:2] + '00'):02d}" + body)

    def date(self, value: str) -> str:
        order, at, day = date_parts(value)
        days = days_like(day)
        new = datetime.date.fromordinal(days[self.number(f"date{digits_like(day)}", len(days), bisect_left(days, day.toordinal()))])
        out = value
        for k, (a, b) in sorted(zip(order, at), key=lambda x: -x[1][0]):
            if k == "m" and value[a].isalpha():
                name = MONTHS[new.month - 1]
                part = name.upper() if value[a:b].isupper() else name.lower() if value[a:b].islower() else name
            else:
                part = str({"y": new.year, "m": new.month, "d": new.day}[k]).zfill(b - a)
            out = out[:a] + part + out[b:]
        return out


FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)
# The months' names.
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]


def digits_like(day: datetime.date) -> tuple[int, int]:
    """What must stay for every layout to be read alike: 0 for 1-9, 1 for 10-12, 2 for over 12."""
    return (day.day > 9) + (day.day > 12), int(day.month > 9)


@lru_cache(8)
def _days(like: tuple[int, int]) -> list[int]:
    every = map(datetime.date.fromordinal, range(FIRST_DAY.toordinal(), LAST_DAY.toordinal() + 1))
    return [d.toordinal() for d in every if digits_like(d) == like]


def days_like(day: datetime.date) -> list[int]:
    return _days(digits_like(day))


def put(value: str, places: list[int], new: str) -> str:
    out = list(value)
    for i, c in zip(places, new):
        out[i] = c
    return "".join(out)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) << (i & 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def mod97(x: str) -> int:
    return int("".join(str(int(c, 36)) for c in x)) % 97


def date_parts(value: str) -> tuple[str, list[tuple[int, int]], datetime.date] | None:
    """Which part is year, month and day, where they are, and the date: y-m-d; d month y or month d y where
    a month is named; else d m y if that is a date, else m d y."""
    at = [m.span() for m in re.finditer(r"\d+|[^\W\d]+", value)]
    name = next((i for i, (a, _) in enumerate(at) if value[a].isalpha()), None)
    for order in ("ymd",) if at[0][1] == 4 else ("dmy", "mdy") if name is None else ("mdy" if name == 0 else "dmy",):
        parts = {k: MONTHS.index(value[a:b].title()) + 1 if value[a].isalpha() else int(value[a:b]) for k, (a, b) in zip(order, at)}
        try:
            day = datetime.date(parts["y"], parts["m"], parts["d"])
        except ValueError:
            continue
        if FIRST_DAY <= day <= LAST_DAY:
            return order, at, day
    return None


def _ssn_ok(value: str) -> bool:
    a, b, c = map(int, value.split("-"))
    return 0 < a < 900 and a != 666 and b > 0 and c > 0


def _iban_ok(value: str) -> bool:
    x = value.replace(" ", "")
    return 15 <= len(x) <= 34 and mod97(x[4:] + x[:4]) == 1


def whole(valid: Callable[[str], bool]) -> Callable[[str], int]:
    return lambda v: len(v) if valid(v) else 0


def group_ends(value: str) -> list[int]:
    """Where the value may be cut: its end, then the ends of its groups from the last on."""
    return [m.end() for m in re.finditer(r"\w+", value)][::-1]


def _iban_fit(value: str) -> int:
    """How much of the value is an IBAN: what has its country's length, else the longest valid cut."""
    ends = sorted(group_ends(value), key=lambda e: len(value[:e].replace(" ", "")) != IBAN_LENGTHS.get(value[:2]))
    return next((e for e in ends if _iban_ok(value[:e])), 0)


def country_code(digits: str) -> str:
    return next((digits[:n] for n in (1, 2, 3) if digits[:n] in COUNTRY_CODES), "")


def _phone_fit(value: str) -> int:
    if NATIONAL.fullmatch(value) or value.isdigit():
        return len(value)
    for end in group_ends(value):
        digits = re.sub(r"[^0-9]", "", value[:end])
        code = country_code(digits)
        if code and 7 <= len(digits) <= 15 and (code != "1" or len(digits) == 11) and value[:end].count("(") == value[:end].count(")"):
            return end
    return 0


#: Characters of an IBAN by country.
IBAN_LENGTHS = {x[:2]: int(x[2:]) for x in "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20".split()}
#: Assigned country codes of telephone numbers.
COUNTRY_CODES = {"1", "7", *"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()}
COUNTRY_CODES |= {str(n) for a, b in ((211, 213), (216, 216), (218, 218), (220, 258), (260, 269), (290, 291), (297, 299), (350, 359), (370, 378), (380, 383), (385, 387), (389, 389), (420, 421), (423, 423), (500, 509), (590, 599), (670, 670), (672, 683), (685, 692), (800, 800), (808, 808), (850, 850), (852, 853), (855, 856), (870, 870), (878, 878), (880, 883), (886, 886), (888, 888), (960, 968), (970, 977), (979, 979), (992, 996), (998, 998)) for n in range(a, b + 1)}
#: Ten digits in a row are a telephone number only behind a word that says so.
LABELLED = re.compile("(?:" + "|".join(f"(?<=(?i:{w}){gap})" for w in ("tel", "phone", "mobile", "cell", "fax", "call") for gap in (" ", ": ", ":", r"\. ")) + r")[2-9][0-9]{2}[2-9][0-9]{6}(?!\w)")
NATIONAL = re.compile(r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|\+[0-9]{1,3}[ .-]?[0-9]{3}[ .-]?[0-9]{3}[ .-]?[0-9]{4}")


# Kind: its shape (each is bounded in length, or starts only where a run of its characters starts, so
# that scans are linear) and how much of a match is valid, 0 if nothing. Earlier kinds win where matches overlap.
SHAPES = {
    "email": (re.compile(r"(?<!\w)\w[\w.%+-]{0,63}@(?:[^\W_](?:[^\W_]|-){0,62}\.){1,8}[^\W\d_]{2,63}(?![\w@])"), len),
    "iban": (re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?!\w)"), _iban_fit),
    "date": (re.compile(r"(?<![\w./-])(?:" + rf"(?i:{'|'.join(MONTHS)}) [0-9]{{1,2}},? [0-9]{{4}}|[0-9]{{1,2}} (?i:{'|'.join(MONTHS)}),? [0-9]{{4}}|" + r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}|[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?:(?=[Tt][0-9]{2}(?::?[0-9]{2}|(?!\w)))|(?![\w/-]|\.[0-9]))"), whole(lambda v: date_parts(v) is not None)),
    "ip": (re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?!\w|\.[0-9])"), len),
    "ssn": (re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"), whole(_ssn_ok)),
    "phone": (re.compile(rf"(?<![\w+])(?:{NATIONAL.pattern})(?!\w|-[0-9])|{LABELLED.pattern}|(?<![\w+])\+[1-9](?:[ .()/-]{{0,2}}[0-9]){{6,14}}(?!\w|-[0-9])"), _phone_fit),
    "card": (re.compile(r"(?<!\w)(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?!\w)"), whole(lambda v: luhn(re.sub(r"[ -]", "", v)))),
}
DIGIT = re.compile(r"[0-9]")


def find(text: str) -> list[tuple[int, int, str]]:
    """Validated values by start; they don't overlap."""
    found: list[tuple[int, int, str]] = []
    at, digit = "@" in text, DIGIT.search(text) is not None
    for kind, (shape, fit) in SHAPES.items():
        if at if kind == "email" else digit:
            starts, more = [a for a, _, _ in found], []
            m = shape.search(text)
            while m:
                a = m.start()
                end, k = a + fit(m.group()), bisect_right(starts, a)
                if end > a and (not k or found[k - 1][1] <= a) and (k == len(starts) or starts[k] >= end):
                    more.append((a, end, kind))
                else:
                    end = a + 1  # a later start within the match may be valid
                m = shape.search(text, end)
            found = sorted(found + more)
    return found


def pseudonymised(text: str, made: Pseudonyms) -> tuple[str, list[tuple[int, int, str]]]:
    found = find(text)
    if not found:
        return text, found
    parts, last = [], 0
    for a, b, kind in found:
        parts += [text[last:a], made.of(kind, text[a:b])]
        last = b
    return "".join(parts) + text[last:], found


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """docs with pseudonyms in text; the schema and all other columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Pseudonyms(key)
        for batch in slices(batches):
            new = [x if x is None else pseudonymised(x, made)[0] for x in batch.column("text").to_pylist()]
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(new, batch.column("text").type))

    return docs.mapInArrow(run, docs.schema)


def report(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text with pseudonyms, n_values, and spans (kind:start:end of the values in the original
    text, in code points, comma-joined). Null text gives null text and no spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Pseudonyms(key)
        for batch in slices(batches):
            done = [(x, []) if x is None else pseudonymised(x, made) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([t for t, _ in done], pa.string()), pa.array([len(f) for _, f in done], pa.int64()), pa.array([",".join(f"{k}:{a}:{b}" for a, b, k in f) for _, f in done])], names=["doc_id", "text", "n_values", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, text string, n_values long, spans string")
