"""Token-id files: independent zstandard frames, a trailing seek table, a checksum for each frame.

Layout of a file, all numbers little-endian:

    frame ...            zstandard frames (with zstandard's own checksum) of ids, 2 or 4 bytes each
    seek table           a skippable zstandard frame whose content is a zstandard frame of
                         u32 bytes an id, u32 frames, u32 documents, then the arrays
                         frames: u64 offset, u32 stored bytes, u32 crc32 of the ids' bytes, u32 documents
                         documents: i64 id, u8 whether the id is null, u64 ids
    footer               u64 offset of the seek table, 8 bytes of magic

Every document is a frame of its own unless a writer is told to gather more ids a frame, so a reader
fetches the footer, the table and the frames of the documents it wants, and decompresses nothing else.

Null text is the empty text (its one id is the end id). A null doc_id sorts first. Rows that repeat a
doc_id are stored one by one, in the order of their texts' hashes; rows alike in both may be dealt to
several files. An empty table gives no file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import new_path, partitions, texts, written
from tracelake.llm.tokens import encoder, slices

MAGIC = b"TLTOKEN1"
SKIPPABLE, BATCH = 0x184D2A50, 1 << 20
FRAME_IDS = 1  # a frame closes behind the document that brings it to so many ids


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class Writer:
    """One file, frame after frame; it holds one frame and the seek table."""

    def __init__(self, path: str, id_bytes: int, level: int = 3):
        import zstandard

        system, inner = _open(path)
        system.create_dir(inner.rpartition("/")[0], recursive=True)
        self.out = system.open_output_stream(inner, compression=None)
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True).compress
        self.id_bytes, self.at, self.frames, self.docs = id_bytes, 0, [], []
        self.parts, self.waiting, self.n_waiting = [], 0, 0

    def add(self, ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray) -> None:
        """Documents' ids laid end to end."""
        begin = at = 0
        for doc_id, n in zip(doc_ids, lengths.tolist()):
            self.docs.append((doc_id, n))
            self.n_waiting += 1
            at += n
            if self.waiting + at - begin >= FRAME_IDS:
                self.parts.append(ids[begin:at])
                self.flush()
                begin = at
        self.parts.append(ids[begin:at])
        self.waiting += at - begin

    def flush(self) -> None:
        ids = np.concatenate([np.zeros(0, np.uint32), *self.parts])
        if len(ids) and int(ids.max()) >> 8 * self.id_bytes:
            raise ValueError(f"id {ids.max()} does not fit in {self.id_bytes} bytes")
        raw = ids.astype(f"<u{self.id_bytes}").tobytes()
        if self.n_waiting:
            frame = self.pack(raw)
            self.out.write(frame)
            self.frames.append((self.at, len(frame), zlib.crc32(raw), self.n_waiting))
            self.at += len(frame)
        self.parts, self.waiting, self.n_waiting = [], 0, 0

    def close(self) -> None:
        self.flush()
        f, d = self.frames, self.docs
        table = struct.pack("<3I", self.id_bytes, len(f), len(d))
        table += b"".join(np.array([x[k] for x in f], kind).tobytes() for k, kind in enumerate(("<u8", "<u4", "<u4", "<u4")))
        table += np.array([x or 0 for x, _ in d], "<i8").tobytes() + np.array([x is None for x, _ in d], "u1").tobytes() + np.array([n for _, n in d], "<u8").tobytes()
        packed = self.pack(table)
        self.out.write(struct.pack("<2I", SKIPPABLE, len(packed)) + packed + struct.pack("<Q", self.at) + MAGIC)
        self.out.close()


class Reader:
    """The seek table of a file; frames are fetched when documents of theirs are asked for."""

    def __init__(self, path: str):
        import zstandard

        system, inner = _open(path)
        self.file = system.open_input_file(inner)
        self.unpack = zstandard.ZstdDecompressor().decompress
        size = self.file.size()
        at, magic = struct.unpack("<Q8s", self.file.read_at(16, size - 16))
        if magic != MAGIC:
            raise ValueError(f"{path} is not a token file")
        table = self.unpack(self.file.read_at(size - 24 - at, at + 8))
        self.id_bytes, n, m = struct.unpack_from("<3I", table)
        self.frames, place = [], 12
        for kind, count in (("<u8", n), ("<u4", n), ("<u4", n), ("<u4", n), ("<i8", m), ("u1", m), ("<u8", m)):
            self.frames.append(np.frombuffer(table, kind, count, place))
            place += count * np.dtype(kind).itemsize
        *self.frames, self.doc_ids, self.null, self.lengths = self.frames
        self.first = np.concatenate([[0], np.cumsum(self.frames[3], dtype=np.int64)])

    def frame(self, k: int) -> np.ndarray:
        """All ids of a frame, checked against its checksum."""
        offset, stored, crc, _ = (int(x[k]) for x in self.frames)
        raw = self.unpack(self.file.read_at(stored, offset))
        if zlib.crc32(raw) != crc:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(raw, f"<u{self.id_bytes}").astype("<u4")

    def documents(self, k: int) -> Iterator[tuple[int, np.ndarray]]:
        """Place in the file, and ids, of each document of a frame."""
        ids, at = self.frame(k), 0
        for i in range(int(self.first[k]), int(self.first[k + 1])):
            n = int(self.lengths[i])
            yield i, ids[at : at + n]
            at += n

    def find(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of the rows with this doc_id; only their frames are read."""
        rows = np.flatnonzero((self.doc_ids == (doc_id or 0)) & (self.null == (doc_id is None)))
        return [dict(self.documents(int(np.searchsorted(self.first, i, "right")) - 1))[int(i)] for i in rows]


MANIFEST = "file string, n_docs long, n_tokens long, first_id long, first_hash long, first_tie int"


def write_token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 0, id_bytes: int | None = None, added: bool = False) -> DataFrame:
    """Encode every text and write the ids in ascending doc_id order, a file for each range of doc_ids.
    Returns the manifest, a row a file. A task that runs again writes another file; only files in the
    manifest count, and it is written once, so lost executors leave no trace in it.
    id_bytes: 2 or 4, by default what the vocabulary's largest id needs. added: see WordIds.encode()."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "token-files")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(tokenizer)
        out, first, n_docs, n_tokens = None, None, 0, 0
        for batch in slices(batches):
            if out is None:
                path = f"{folder}/{uuid.uuid4().hex}.tok"
                out, first = Writer(path, id_bytes or (2 if max(codec.top_id, end_id) < 1 << 16 else 4)), [batch.column(c)[0].as_py() for c in ("doc_id", "h", "tie")]
            ids, lengths = codec.encode(batch.column("text").to_pylist(), end_id, added)
            out.add(ids, batch.column("doc_id").to_pylist(), lengths)
            n_docs, n_tokens = n_docs + batch.num_rows, n_tokens + len(ids)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [path], "n_docs": [n_docs], "n_tokens": [n_tokens], "first_id": pa.array([first[0]], pa.int64()), "first_hash": [first[1]], "first_tie": pa.array([first[2]], pa.int32())})

    # `tie` lets rows that are alike be split over files; which of them goes where makes no difference.
    keyed = texts(docs).withColumn("h", F.xxhash64("text")).withColumn("tie", F.pmod(F.monotonically_increasing_id(), F.lit(1024)).cast("int"))
    dealt = keyed.repartitionByRange(partitions(spark), "doc_id", "h", "tie").sortWithinPartitions("doc_id", "h", "tie")
    return written(dealt.mapInArrow(write, MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Every document of the files: doc_id, start (ids of all documents before it), n_tokens, and ids
    as little-endian unsigned 32-bit integers. The sum over earlier files is over the manifest, a row a file."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
                file = Reader(path)
                starts = base + np.concatenate([[0], np.cumsum(file.lengths, dtype=np.int64)])
                rows, size, a = [], 0, 0
                for k in range(len(file.frames[0])):
                    rows += [x.tobytes() for _, x in file.documents(k)]
                    size += 4 * int(file.lengths[file.first[k] : file.first[k + 1]].sum())
                    if size >= BATCH or k + 1 == len(file.frames[0]):
                        b = int(file.first[k + 1])
                        ids = pa.array(file.doc_ids[a:b], mask=file.null[a:b].astype(bool))
                        yield pa.RecordBatch.from_pydict({"doc_id": ids, "start": pa.array(starts[a:b]), "n_tokens": pa.array(file.lengths[a:b].astype(np.int64)), "ids": pa.array(rows, pa.binary())})
                        rows, size, a = [], 0, b

    order = Window.orderBy(F.col("first_id").asc_nulls_first(), "first_hash", "first_tie").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.select("file", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("base"))
    return based.repartition(partitions(manifest.sparkSession)).mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")
