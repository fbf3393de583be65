"""Secret scans: known shapes, and literals that source or configuration assigns to sensitive names.

Base kinds, leftmost and non-overlapping within a kind: assign, access, hex (BASE below). The kind
`literal` is added by a small lexer: it reads `=`, `:=`, `=>` and `:` as name-literal pairs (quoted or bare
names and values, subscripts, declarations, JSON and YAML keys, `+` between strings, strings in triple
quotes over several lines) and setter calls with one literal, remembers constants, follows names that
stand for them, and scores each literal by the words of its target's name and its own look. A span that a
base span already covers is not repeated. A line that is a key and one unquoted word (.env, INI, YAML)
gives all of that word; what looks like a call, a list or a type does not count. A statement goes on over
line ends behind =, :, + and in the bracket behind an =, up to a line that assigns.

The lexer takes time in proportion to the text: a quote that nothing closes is tried once a line, and a value
ends at the second `:` or `=` behind its name. However many literals a name stands for, and however long they
are together, all are followed: a value is kept as the parts it is made of, and its score needs only the counts
of its characters (what is joined adds them) and its ends.

Positions are code points, ends exclusive. Null text is the empty text, which has no spans; repeated rows
are scanned one by one; a null doc_id stays null; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import MAX_EMAX, MIN_EMIN, Context, Decimal
from functools import cached_property, lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from tracelake.llm.common import texts
from tracelake.llm.tokens import slices

# The base kinds, and the least length of what they must hold.
BASE = {
    "assign": (re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]{24,}"), 0, 24),  # the runs of [0-9a-f]+ that are long enough
}
KINDS = ["assign", "access", "hex", "literal"]

#: A name's words, and how much each says that its value is secret.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "privatekey": 1.0, "accesskey": 1.0, "bearer": 0.8, "auth": 0.5, "signing": 0.5, "encryption": 0.5, "private": 0.4, "access": 0.4, "api": 0.4, "key": 0.5, "salt": 0.4, "session": 0.4}
HARMLESS = {"name", "id", "path", "file", "url", "uri", "type", "length", "count", "expiry", "ttl", "field", "label", "hint", "policy", "public", "format", "regex", "header", "prefix", "size"}
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|<.*>|\$\{?.*|%.*%|\{\{.*|your.*|change.?me|example.*|placeholder|dummy|none|null|true|false|todo|test|redacted|undefined)$")
LEAST_SCORE = 0.8
ANY_NAME = re.compile("(?i)" + "|".join(sorted({w[:4] for w in SENSITIVE})))  # without one of these no name is sensitive

TOKEN = re.compile(
    r"""(?P<quote>\"{3}|'{3}|["'`])
      |(?P<op>:=|=>|==|!=|<=|>=|=|:|\+)
      |(?P<end>[;,{}()\[\]])
      |(?P<comment>\n|\#|//)
      |(?P<word>[^\s"'`=:+;,{}()\[\]\#<>!]+(?:\+[^\s"'`=:+;,{}()\[\]\#<>!]+)*)""",
    re.VERBOSE,
)
#: What closes a string behind its opening quote. Strings of one quote end on their line.
CLOSE = {q: re.compile(rf"(?:[^{q}\\\n]|\\.)*+{q}") for q in "\"'`"} | {3 * q: re.compile(rf"(?s:[^{q}\\]|\\.|{q}(?!{q}{q}))*+{3 * q}") for q in "\"'"}
PREFIXES = {"r", "b", "f", "u", "br", "rb", "fr", "rf"}
#: First words of functions that read rather than set.
READERS = {"get", "read", "load", "fetch", "find", "has", "is", "check", "validate", "verify", "parse", "require", "lookup", "delete", "remove", "env", "test", "assert", "print", "log"}
NAME = re.compile(r"[^\W\d][\w.$-]*\Z")
CONFIG = re.compile(r"""\s*(?:export\s+|-\s+)?(["']?)([^\W\d][\w.$-]*)\1[^\S\n]*(?:=(?![=>])|:(?!=))[^\S\n]*(\S+)(?:\s+[#;].*)?\s*\Z""")
#: Values that are source: calls, quotes, lists, ends of statements, types, attributes.
SOURCE = re.compile(r"""["'`]|\w\(|^[(\[{]|[,;({\[\\]$|^(?:self|this|os|process|env|config|settings)\.|^(?:string|String|SecretStr|secrets?|bytes|boolean|number|integer|object|Optional)$""")
ASSIGNS, GOES_ON = (":=", "=>", "=", ":"), (":=", "=>", "=", ":", "+")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    for kind, (pattern, group, least) in BASE.items():
        if kind == "assign" and "=" not in text and ":" not in text:
            continue
        found += [(*m.span(), kind) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return found


def name_words(name: str) -> list[str]:
    split = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", name)
    return [w for w in re.split(r"[\W_]+|\s", split.lower()) if w]


@lru_cache(10_000)
def weight(name: str) -> float:
    """How much a target's name says that its value is secret, 0 to 1. A literal's score is this times its mixture."""
    words = name_words(name)
    joined = "".join(words)
    target = min(1.0, sum(SENSITIVE.get(w, 0) for w in words) or max((v for k, v in SENSITIVE.items() if len(k) > 5 and k in joined), default=0))
    return 0.0 if not target or words[-1] in HARMLESS else target


@dataclass
class Look:
    """What a score needs of a text. counts: its characters in order of their first places; head and tail: its
    first and last ENDS characters; gap: white space between others (then nothing else is needed)."""

    counts: dict[str, Decimal]
    head: str
    tail: str
    gap: bool

    def is_placeholder(self, n: Decimal) -> bool:
        """Of a long text the middle stands as the set of its characters, which the patterns can't tell from all."""
        if n <= 2 * ENDS:
            return bool(PLACEHOLDER.match(self.head + self.tail[len(self.head) + len(self.tail) - int(n) :]))
        ends = Counter(self.head + self.tail)
        return bool(PLACEHOLDER.match(self.head + "".join(c for c, k in self.counts.items() if k > ends[c]) + self.tail))

    @cached_property
    def mixture(self) -> float:
        """0 to about 1.5, by length and mixture of characters."""
        n = Decimal(0)
        for k in self.counts.values():
            n = COUNTS.add(n, k)
        if n < 6 or self.gap or self.is_placeholder(n):
            return 0.0
        shares = [float(COUNTS.divide(k, n)) for k in self.counts.values()]
        entropy = -sum(p * math.log2(p) for p in shares if p)
        kinds = sum(any(f(c) for c in self.counts) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
        return 0.4 + min(entropy, 4) / 8 + kinds / 10


ENDS, GAP = 32, Look({}, "", "", True)
#: Doubled names count more characters than any machine number holds; ratios need no more digits.
COUNTS = Context(prec=40, Emax=MAX_EMAX, Emin=MIN_EMIN, traps=[])


def look(text: str) -> Look:
    if any(map(str.isspace, text.strip())):
        return GAP
    return Look({c: Decimal(n) for c, n in Counter(text).items()}, text[:ENDS], text[-ENDS:], False)


def joined_look(parts: list[Look]) -> Look:
    """Of the texts behind each other."""
    solid = blank = False  # characters so far, and white space behind them
    for x in parts:
        full = not all(map(str.isspace, x.counts))
        if x.gap or (full and solid and (blank or x.head[0].isspace())):
            return GAP
        if full:
            solid, blank = True, x.tail[-1].isspace()
        elif x.head:
            blank = solid
    counts: dict[str, Decimal] = {}
    times = Counter(map(id, parts))
    for x in {id(x): x for x in parts}.values():
        for c, n in x.counts.items():
            counts[c] = COUNTS.fma(n, times[id(x)], counts.get(c, Decimal(0)))
    head = tail = ""
    for x in parts:
        if len(head) >= ENDS:
            break
        head += x.head
    for x in reversed(parts):
        if len(tail) >= ENDS:
            break
        tail = x.tail + tail
    return Look(counts, head[:ENDS], tail[-ENDS:], False)


class Values:
    """The values of a text's assignments. A value's parts are literals (start, end) and numbers of earlier values."""

    def __init__(self, text: str):
        self.text, self.parts, self.looks = text, [], {}
        self.literal = lru_cache(10_000)(look)

    def add(self, parts: list[tuple[int, int] | int]) -> int:
        self.parts.append(parts)
        return len(self.parts) - 1

    def look(self, value: int) -> Look:
        """Each value is looked at once, after those it is made of."""
        open_values = [value]
        while open_values:
            parts = self.parts[i := open_values[-1]]
            if i not in self.looks and (first := [p for p in parts if isinstance(p, int) and p not in self.looks]):
                open_values += first
                continue
            open_values.pop()
            if i not in self.looks:
                seen = [self.looks[p] if isinstance(p, int) else self.literal(self.text[slice(*p)]) for p in parts]
                self.looks[i] = seen[0] if len(seen) == 1 else joined_look(seen)
        return self.looks[value]

    def literals(self, values: Iterable[int]) -> set[tuple[int, int]]:
        """Where all literals of these values stand."""
        out, met = set(), set(values)
        left = list(met)
        while left:
            for p in self.parts[left.pop()]:
                if not isinstance(p, int):
                    out.add(p)
                elif p not in met:
                    met.add(p)
                    left.append(p)
        return out


def lexed(text: str, at: int, dead: dict[str, int]) -> tuple[list[tuple[str, int, int]], int]:
    """Tokens (kind, start, end; of a string its inside) up to the end of the line, or of the line on which
    its last string ends, and where the next line starts. dead: up to where a quote is known to open nothing."""
    tokens = []
    while m := TOKEN.search(text, at):
        kind, at = m.lastgroup, m.end()
        if kind == "comment":
            if m.group() != "\n":
                at = text.find("\n", at) + 1 or len(text)
            return tokens, at
        if kind != "quote":
            tokens.append((kind, m.start(), at))
            continue
        quote = m.group()
        if m.start() < dead.get(quote, 0) or (quote == "'" and tokens and tokens[-1][0] == "word" and tokens[-1][2] == m.start() and text[slice(*tokens[-1][1:])].lower() not in PREFIXES):
            continue  # nothing closes it, or it is an apostrophe
        if closed := CLOSE[quote].match(text, at):
            tokens.append(("string", at, closed.end() - len(quote)))
            at = closed.end()
        else:
            dead[quote] = len(text) if len(quote) == 3 else text.find("\n", at) + 1 or len(text)
    return tokens, len(text)


def assignments(values: Values) -> Iterator[tuple[str, int]]:
    """(target, number of its value) of each assignment whose value is known; constants that a name stands
    for are followed."""
    text = values.text
    constants: dict[str, int] = {}
    statement: list[tuple[str, int, int]] = []
    op_of = lambda t: text[t[1] : t[2]] if t[0] == "op" else ""

    def value_of(tokens: list, i: int) -> int | None:
        """Of the tokens behind an assignment; None where it is not known."""
        parts, known, plus, last, typed = [], True, True, None, op_of(tokens[i]) != ":"
        for j in range(i + 1, len(tokens)):
            t = tokens[j]
            if t[0] == "op":
                if op_of(t) == "+" and not plus:
                    plus = True
                    continue
                if op_of(t) == "=" and not typed:  # a typed declaration: name: type = value
                    parts, known, plus, typed = [], True, True, True
                    continue
                break
            if not plus and not (last and t[0] == "string" and "\n" in text[last[2] : t[1]]):
                break  # strings on lines that follow each other are one
            plus, last, word = False, t if t[0] == "string" else None, text[t[1] : t[2]]
            if t[0] == "string":
                parts.append(t[1:])
            elif word in constants:
                parts.append(constants[word])
            elif "+" in word and any(map(constants.__contains__, pieces := word.split("+"))):
                parts += [constants[x] for x in pieces if x in constants]
                known = known and all(map(constants.__contains__, pieces))
            elif "+" in word or any(map(str.isdigit, word)):
                parts.append(t[1:])
            else:  # a name that stands for nothing known
                known = False
        return values.add(parts) if known and parts else None

    def pairs(tokens: list) -> Iterator[tuple[str, int]]:
        for i, t in enumerate(tokens):
            if i and t[0] == "op" and op_of(t) in ASSIGNS:
                name = text[tokens[i - 1][1] : tokens[i - 1][2]]
                if NAME.match(name):
                    if (found := value_of(tokens, i)) is not None:
                        constants[name] = found
                        yield name, found
                    else:
                        constants.pop(name, None)

    at = depth = 0
    dead: dict[str, int] = {}
    while at < len(text):
        stop = text.find("\n", at) + 1 or len(text)
        line = text[at:stop]
        if not statement and "=" not in line and ":" not in line and "(" not in line:
            at = stop
            continue
        start, (tokens, at) = at, lexed(text, at, dead)
        if statement and (not line.strip() or any(op_of(t) in ASSIGNS for t in tokens)):
            yield from pairs(statement)
            statement, depth = [], 0
        m = None if statement else CONFIG.match(line)
        if m and m[3] not in constants and not SOURCE.search(m[3]):
            found = values.add([(start + m.start(3), start + m.end(3))])
            yield m[2], found
            if "=" not in m[3] and ":" not in m[3]:
                constants[m[2]] = found
        for i, t in enumerate(tokens):
            if t[0] != "end":
                statement.append(t)
                continue
            mark = text[t[1]]
            if mark == "]" and i and tokens[i - 1][0] == "string":
                continue  # a subscript: what follows may assign to it
            if mark == "(" and i and tokens[i - 1][0] == "word" and tokens[i - 1][2] == t[1] and i + 2 < len(tokens) and tokens[i + 1][0] == "string" and text[tokens[i + 2][1]] in ",)":
                value, name = text[tokens[i + 1][1] : tokens[i + 1][2]], text[tokens[i - 1][1] : t[1]].rpartition(".")[2]
                if any(map(str.isdigit, value)) and (words := name_words(name)) and words[0] not in READERS:
                    yield name, values.add([tokens[i + 1][1:]])
            goes_on = bool(statement) and op_of(statement[-1]) in GOES_ON
            if mark == "(" and (depth or goes_on):
                depth += 1
            elif mark == ")" and depth > 1:
                depth -= 1
            else:
                if statement:
                    yield from pairs(statement)
                statement, depth = [], 0
        if statement and not depth and op_of(statement[-1]) not in GOES_ON:
            yield from pairs(statement)
            statement = []
    yield from pairs(statement)


def spans(text: str) -> list[tuple[int, int, str]]:
    """All spans by start, then by kind as listed in KINDS."""
    found = base_spans(text)
    if ANY_NAME.search(text) and ("=" in text or ":" in text or "(" in text):
        base = sorted(found)
        starts, reach = [a for a, _, _ in base], list(accumulate((b for _, b, _ in base), max))
        covered = lambda a, b: (k := bisect_right(starts, a)) > 0 and reach[k - 1] >= b
        values = Values(text)
        secret = [v for name, v in assignments(values) if (w := weight(name)) and w * values.look(v).mixture >= LEAST_SCORE]
        more = {(a, b, "literal") for a, b in values.literals(secret) if b > a and not covered(a, b)}
        whole, reach = [], 0
        for a, b, kind in sorted(more, key=lambda x: (x[0], -x[1])):  # a part of a longer literal is not repeated
            if b > reach:
                whole.append((a, b, kind))
                reach = b
        found += whole
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and spans (array of kind, start, end), a row a document."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [[{"kind": k, "start": a, "end": b} for a, b, k in spans(x)] for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], names=["doc_id", "spans"])

    return texts(docs).mapInArrow(run, "doc_id long, spans array<struct<kind string, start long, end long>>")
