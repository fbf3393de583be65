"""Pre-tokens and token ids inside tasks.

The byte-level vocabularies split a text by one fixed pattern before any merge:

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

word_starts() finds the same pieces for a whole batch of texts with array operations. A piece's ids
depend on the piece alone, so each distinct piece needs the tokenizer once in a worker.

A tokenizer's added tokens (<|endoftext|>) come before the pattern: asked to, WordIds cuts texts at their
literals, the longest of those that start first, and gives each its one id.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
_classes: np.ndarray | None = None
_encoders: dict[str, WordIds] = {}


def char_classes() -> np.ndarray:
    """The class of each code point as the tokenizers library sees it. Two Unicode tables of different
    age agree on nearly all; the few points on which they don't are tried on the library itself."""
    global _classes
    if _classes is None:
        import unicodedata

        import regex
        from tokenizers.pre_tokenizers import ByteLevel

        every = "".join(map(chr, [*range(0xD800), *[0] * 0x800, *range(0xE000, 0x110000)]))
        table = np.full(0x110000, OTHER, np.uint8)
        for kind, pattern in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
            for m in regex.finditer(pattern, every):
                table[m.start() : m.end()] = kind
        kinds = {"L": LETTER, "N": NUMBER}
        older = np.fromiter((kinds.get(unicodedata.category(c)[0], OTHER) for c in every), np.uint8, len(every))
        split = ByteLevel(add_prefix_space=False).pre_tokenize_str
        for c in np.flatnonzero((table != older) & (table != SPACE)):
            table[c] = LETTER if len(split(f"a{chr(c)}")) == 1 else NUMBER if len(split(f"1{chr(c)}")) == 1 else OTHER
        _classes = table
    return _classes


def word_starts(points: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Positions in points (code points of texts laid end to end) at which pieces start.
    doc_starts: where the non-empty texts start."""
    n = len(points)
    if n == 0:
        return np.zeros(0, np.int64)
    kind = char_classes()[points]
    first = np.zeros(n + 4, bool)  # of a text; the places behind the end count too
    first[doc_starts] = first[n:] = True
    start = np.ones(n + 4, bool)
    start[1:n] = kind[1:] != kind[:-1]
    start |= first
    # A run behind white space: the last blank joins it if it is a space, else stands alone.
    behind = np.flatnonzero(start[1:n] & ~first[1:n] & (kind[:-1] == SPACE)) + 1
    start[behind - 1] = True
    start[behind[points[behind - 1] == 32]] = False
    # Contractions: an apostrophe that starts a piece takes one or two letters.
    at = np.flatnonzero(points == 39)
    at = at[start[at] & ~first[at + 1]]
    if len(at):
        ahead = np.zeros(n + 4, np.uint32)
        ahead[:n] = points
        a, b = ahead[at + 1], ahead[at + 2]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ~first[at + 2] & ((np.isin(a, [ord("r"), ord("v")]) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        start[at[one | two] + 1] = False
        start[at[one] + 2] = True
        start[at[two] + 2] = False
        start[at[two] + 3] = True
    return np.flatnonzero(start[:n])


def split_batch(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """The pieces of all texts in order, and how many each text has."""
    whole = "".join(texts)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths)
    points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    starts = word_starts(points, (ends - lengths)[lengths > 0])
    cuts = starts.tolist()
    cuts.append(len(whole))
    pieces = [whole[a:b] for a, b in zip(cuts, cuts[1:])]
    upto = np.searchsorted(starts, np.concatenate([[0], ends]), "left")
    return pieces, np.diff(upto)


class Places(dict):
    """The place of each distinct piece, in the order of arrival."""

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        return n


class WordIds:
    """Token ids of pieces by the tokenizers library's model; a worker remembers about `most` distinct pieces."""

    def __init__(self, path: str, most: int = 300_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        self.model, self.top_id = whole.model, max(whole.get_vocab(with_added_tokens=True).values(), default=0)
        with open(path, encoding="utf-8") as f:
            added = json.load(f).get("added_tokens") or []
        if any(x.get(k) for x in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path} has added tokens that take in or look at their surroundings")
        self.added = {x["content"]: x["id"] for x in added}
        self.literals = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        # The vocabulary writes each byte as one printable character: itself, or the next one from U+0100.
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = iter(range(256, 512))
        self.byte_chars = [b if b in printable else next(others) for b in range(256)]
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.place = Places()
        self.flat = np.zeros(1 << 16, np.uint32)
        self.bounds = np.zeros(1 << 14, np.int64)

    def split(self, texts: list[str]) -> tuple[list[str | int], np.ndarray]:
        """As split_batch(), with the ids of added tokens in the place of their literals."""
        if not any(x in t for t in texts for x in self.added):
            return split_batch(texts)
        cut = [self.literals.split(t) for t in texts]  # ordinary text and literals by turns
        pieces, counts = split_batch([x for parts in cut for x in parts[::2]])
        out, n_out, ends = [], [], iter(np.cumsum(counts).tolist())
        at = 0
        for parts in cut:
            begin = len(out)
            for i, x in enumerate(parts):
                if i % 2:
                    out.append(self.added[x])
                else:
                    end = next(ends)
                    out += pieces[at:end]
                    at = end
            n_out.append(len(out) - begin)
        return out, np.array(n_out, np.int64)

    def add(self, words: list[str | int]) -> None:
        got = [[w] if isinstance(w, int) else [x.id for x in self.model.tokenize(w.encode().decode("latin-1").translate(self.byte_chars))] for w in words]
        n, held = len(self.place) - len(words), self.bounds[len(self.place) - len(words)]
        ends = held + np.cumsum(np.fromiter(map(len, got), np.int64, len(got)))
        self.flat = grown(self.flat, ends[-1])
        self.bounds = grown(self.bounds, len(self.place) + 1)
        self.flat[held : ends[-1]] = [i for x in got for i in x]
        self.bounds[n + 1 : n + 1 + len(words)] = ends

    def encode(self, texts: list[str], end_id: int | None, added: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and each text's number of ids; end_id closes each text. added: literals of
        added tokens get their ids, else they are ordinary text."""
        pieces, n_pieces = self.split(texts) if added else split_batch(texts)
        if len(self.place) > self.most:
            self.clear()
        before = len(self.place)
        at = np.fromiter(map(self.place.__getitem__, pieces), np.int64, len(pieces))
        if len(self.place) > before:
            self.add(list(islice(self.place, before, None)))
        n_ids = self.bounds[at + 1] - self.bounds[at]
        ids = spread(self.flat, self.bounds[at], n_ids)
        upto = np.concatenate([[0], np.cumsum(n_ids)])
        lengths = np.diff(upto[np.concatenate([[0], np.cumsum(n_pieces)])])
        if end_id is None:
            return ids, lengths
        return np.insert(ids, np.cumsum(lengths), end_id).astype(np.uint32), lengths + 1


def grown(x: np.ndarray, n: int) -> np.ndarray:
    return x if n <= len(x) else np.concatenate([x, np.zeros(max(n - len(x), len(x)), x.dtype)])


def spread(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """flat[starts[i] : starts[i] + lengths[i]] for each i, laid end to end."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return flat[:0]
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1])]


def encoder(path: str) -> WordIds:
    """One for each vocabulary file and worker; workers are reused over tasks."""
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    return _encoders[path]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Batches cut so that one has about `most` bytes of text, or one row that is longer."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        begin = total = 0
        for i, x in enumerate(size):
            if i > begin and total + x > most:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += x
        if begin < batch.num_rows:
            yield batch.slice(begin)


def crc_of_ids(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))
