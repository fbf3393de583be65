"""Byte-level BPE by a global shuffle of distinct words.

1. Each block (a task's texts, up to BLOCK_BYTES) explodes its texts into pre-tokens with positions and
   keeps each distinct word of the block once; the positions stay behind as word numbers.
2. The words of all blocks are shuffled by their hash, so that all blocks' asking for a word meet in one
   bucket. There each distinct word is encoded once and its ids go back to the blocks. A word goes out
   at most once a block, however often it occurs; a shuffled row carries a block's words of one bucket.
3. Each block puts the ids back by position.

A block is found again by its partition and place there, so the rows must be dealt alike both times they
are read: a scan does, and what is more than a scan is written first. Bits of a checksum over its words are
part of a block's number, so that a block that was dealt otherwise would find no ids and the job fail; it
never guesses.

Decoding looks every id up in the token-byte table, whose size is that of the vocabulary.

Null text is the empty text, which has no ids. A null doc_id stays null; repeated rows are encoded one
by one. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import partitions, replayable, texts
from tracelake.llm.tokens import Places, slices, split_batch, spread

BLOCK_BYTES, BLOCK_WORDS = 16 << 20, 1 << 20
CRC_BITS, ORDINAL_BITS = 20, 20  # what is left names eight million partitions
REMEMBERED = 200_000  # distinct words that a bucket's task holds at once
OUT_BYTES = 4 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a line for each token, its bytes in base64 and its id."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def squeezed(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, their low bytes first, compressed."""
    import zstandard

    return zstandard.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def expanded(data: bytes) -> np.ndarray:
    import zstandard

    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()


class Block:
    """Texts as numbers of the block's distinct words."""

    def __init__(self) -> None:
        self.words, self.codes, self.counts, self.doc_ids, self.bytes = Places(), [], [], [], 0

    def add(self, batch: pa.RecordBatch) -> None:
        pieces, counts = split_batch(batch.column("text").to_pylist())
        self.codes.append(np.fromiter(map(self.words.__getitem__, pieces), np.uint32, len(pieces)))
        self.counts.append(counts)
        self.doc_ids += batch.column("doc_id").to_pylist()
        self.bytes += batch.nbytes

    def number(self, ordinal: int) -> int:
        if ordinal >> ORDINAL_BITS:
            raise ValueError(f"a partition has over {1 << ORDINAL_BITS} blocks")  # of 16 MB: 16 TB
        crc = zlib.crc32("\0".join(self.words).encode()) & ((1 << CRC_BITS) - 1)
        return ((TaskContext.get().partitionId() << ORDINAL_BITS) + ordinal << CRC_BITS) + crc

    def dealt(self, n_buckets: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Words, their codes, their buckets, and the words in order of bucket and falling frequency."""
        codes = np.concatenate([np.zeros(0, np.uint32), *self.codes])
        words = [w.encode() for w in self.words]
        buckets = np.fromiter((zlib.crc32(w) % n_buckets for w in words), np.int64, len(words))
        return words, codes, buckets, np.lexsort((-np.bincount(codes, minlength=len(words)), buckets))


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Block]]:
    """Each with its number: the partition's, its place there, some bits of its checksum."""
    ordinal, block = 0, Block()
    for batch in slices(batches):
        block.add(batch)
        if block.bytes >= BLOCK_BYTES or len(block.words) >= BLOCK_WORDS:
            yield block.number(ordinal), block
            ordinal, block = ordinal + 1, Block()
    if block.doc_ids:
        yield block.number(ordinal), block


def asking(n_buckets: int):
    """A row for each block and bucket that has words of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for number, block in blocks(batches):
            words, _, buckets, order = block.dealt(n_buckets)
            cuts = np.flatnonzero(np.diff(buckets[order], prepend=-1, append=n_buckets))
            for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
                part = [words[i] for i in order[a:b].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([int(buckets[order[a]])], pa.int32()), pa.array([number]), pa.array([squeezed(np.fromiter(map(len, part), np.int64, len(part)))]), pa.array([zstandard.compress(b"".join(part), 3)])], names=["bucket", "block", "lengths", "words"])

    return run


def positions(n_buckets: int):
    """A row for each block: its documents, their numbers of words, and the word numbers. Word number
    i * n_buckets + b is place i of bucket b, so frequent words have low numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block in blocks(batches):
            words, codes, buckets, order = block.dealt(n_buckets)
            name = np.empty(len(words), np.int64)
            name[order] = np.arange(len(words)) - np.searchsorted(buckets[order], buckets[order], "left")
            name = name * n_buckets + buckets
            counts = np.concatenate(block.counts).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([len(words)]), pa.array([block.doc_ids], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int32())), pa.array([squeezed(name[codes])])], names=["block", "n_words", "doc_ids", "counts", "codes"])

    return run


def answering(ranks_path: str):
    """The ids of each row's words; a bucket's distinct words are encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        import tiktoken
        import zstandard

        codec = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(ranks_path), special_tokens={})
        known: dict[bytes, bytes] = {}
        for batch in batches:
            lengths, ids = [], []
            for packed_lengths, packed in zip(batch.column("lengths").to_pylist(), batch.column("words").to_pylist()):
                ends, data, got = np.cumsum(expanded(packed_lengths), dtype=np.int64).tolist(), zstandard.decompress(packed), []
                if len(known) > REMEMBERED:
                    known.clear()
                for a, b in zip([0, *ends], ends):
                    word = data[a:b]
                    if (found := known.get(word)) is None:
                        found = known[word] = np.array(codec.encode_ordinary(word.decode()), "<u4").tobytes()
                    got.append(found)
                lengths.append(squeezed(np.fromiter(map(len, got), np.int64, len(got)) // 4))
                ids.append(squeezed(np.frombuffer(b"".join(got), "<u4")))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("bucket"), pa.array(lengths, pa.binary()), pa.array(ids, pa.binary())], names=["block", "bucket", "lengths", "ids"])

    return run


def rebuilding(n_buckets: int):
    """For rows sorted by block and bucket, a block's positions (bucket -1) first: its documents' ids."""

    def done(payload, answers) -> Iterator[pa.RecordBatch]:
        n_words, doc_ids, counts, codes = payload
        if sum(len(n) for _, n, _ in answers) != n_words:
            raise RuntimeError("a block's words differ between two reads of the documents")
        slots = n_buckets * max((len(n) for _, n, _ in answers), default=0)
        starts, n_ids = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
        at = 0
        for bucket, n, ids in answers:
            n_ids[bucket : bucket + n_buckets * len(n) : n_buckets] = n
            starts[bucket : bucket + n_buckets * len(n) : n_buckets] = at + np.cumsum(n) - n
            at += len(ids)
        flat = np.concatenate([np.zeros(0, "<u4"), *(ids for _, _, ids in answers)])
        codes, upto, a = expanded(codes), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), 0
        while a < len(doc_ids):
            b = max(a + 1, int(np.searchsorted(upto, upto[a] + OUT_BYTES // 8, "right")) - 1)
            part = codes[upto[a] : upto[b]]
            ids = spread(flat, starts[part], n_ids[part])
            cut = np.concatenate([[0], np.cumsum(n_ids[part])])[upto[a : b + 1] - upto[a]]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc_ids[a:b], pa.int64()), "n_tokens": pa.array(np.diff(cut)), "ids": pa.array([ids[x:y].tobytes() for x, y in zip(cut[:-1].tolist(), cut[1:].tolist())], pa.binary())})
            a = b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, payload, answers = None, None, []
        for batch in batches:
            for i in range(batch.num_rows):
                number, bucket = batch.column("block")[i].as_py(), batch.column("bucket")[i].as_py()
                if number != block:
                    if payload is not None:
                        yield from done(payload, answers)
                    if bucket != -1:
                        raise RuntimeError("a block's words differ between two reads of the documents")
                    block, payload, answers = number, tuple(batch.column(k)[i].as_py() for k in ("n_words", "doc_ids", "counts", "codes")), []
                else:
                    answers.append((bucket, expanded(batch.column("lengths")[i].as_py()).astype(np.int64), expanded(batch.column("ids")[i].as_py())))
        if payload is not None:
            yield from done(payload, answers)

    return run


def encode(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, n_tokens, and ids as little-endian unsigned 32-bit integers."""
    rows, n = replayable(texts(docs), "bpe-texts"), partitions(docs.sparkSession)
    asked = rows.mapInArrow(asking(n), "bucket int, block long, lengths binary, words binary").repartition(n, "bucket").sortWithinPartitions("bucket")
    answers = asked.mapInArrow(answering(ranks_path), "block long, bucket int, lengths binary, ids binary")
    payload = rows.mapInArrow(positions(n), "block long, n_words long, doc_ids array<long>, counts array<int>, codes binary").withColumn("bucket", F.lit(-1))
    dealt = payload.unionByName(answers, allowMissingColumns=True).repartition(n, "block").sortWithinPartitions("block", "bucket")
    return dealt.mapInArrow(rebuilding(n), "doc_id long, n_tokens long, ids binary")


def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table by id: all bytes end to end, starts, lengths."""
    ranks = read_ranks(path)
    table = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        table[i] = token
    lengths = np.array([len(x) for x in table], np.int64)
    return np.frombuffer(b"".join(table), np.uint8), np.cumsum(lengths) - lengths, lengths


def decode(tokens: DataFrame, ranks_path: str) -> DataFrame:
    """tokens (doc_id, n_tokens, ids) with the column decoded: the bytes the ids stand for. The join with
    the token-byte table runs inside batches, by position in the table. Null ids decode to no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, starts, sizes = token_bytes(ranks_path)
        for batch in slices(batches, "ids", OUT_BYTES):
            ids = [x or b"" for x in batch.column("ids").to_pylist()]
            every = np.frombuffer(b"".join(ids), "<u4")
            bytes_ = spread(flat, starts[every], sizes[every]).tobytes()
            cut = np.concatenate([[0], np.cumsum(sizes[every])])[np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids], dtype=np.int64)])].tolist()
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_tokens": batch.column("n_tokens"), "ids": pa.array(ids, pa.binary()), "decoded": pa.array([bytes_[a:b] for a, b in zip(cut, cut[1:])], pa.binary())})

    return tokens.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")
