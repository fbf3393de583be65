"""Token files, packing and byte-level BPE against the public libraries."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from tracelake.llm import bpe, packing, token_files
from tracelake.llm.tokens import split_batch

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [None, "", "a", "It's 's ''s we'll  \n\n x\t y  ", "<|endoftext|> é中文 ½Ⅷ\x00 　z", "word " * 4000, "x" * 30000, "same", "same", "don't 'd'D  'rest"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None if i == 6 else i, t, i * 2, "k", b"z", i) for i, t in enumerate(TEXTS)] + [(7, "same", 1, "k", b"z", 1), (7, "other", 1, "k", b"z", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, h long, block string, ids binary, bucket int").repartition(3)


def expected(codec_ids):
    rows = [(None if i == 6 else i, t) for i, t in enumerate(TEXTS)] + [(7, "same"), (7, "other")]
    return sorted(((d is not None, d or 0, codec_ids(t or "")) for d, t in rows), key=repr)


def hf():
    t = Tokenizer.from_file(JSON)
    return lambda x: t.encode(x, add_special_tokens=False).ids


def test_split_like_the_pattern():
    pattern, rng = regex.compile(public_tokenizers.PATTERN), random.Random(3)
    for _ in range(3000):
        texts = ["".join(rng.choice("ab'strevmld  \n\t'12é中,.!? 　½''") for _ in range(rng.randint(0, 14))) for _ in range(3)]
        pieces, n = split_batch(texts)
        want = [pattern.findall(t) for t in texts]
        assert pieces == sum(want, []) and list(n) == list(map(len, want))


def test_token_files_round_trip(spark, docs, tmp_path):
    manifest = token_files.write_token_files(docs, JSON, added=True, folder=f"file://{tmp_path}")
    got = token_files.read_token_files(manifest).collect()
    encode = hf()
    assert sorted(((r.doc_id is not None, r.doc_id or 0, np.frombuffer(r.ids, "<u4").tolist()) for r in got), key=repr) == expected(lambda t: [*encode(t), 0])
    files = [token_files.Reader(r.file) for r in manifest.collect()]
    assert sum(len(x.frames[0]) for x in files) == len(got)  # a frame a document
    upto = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == upto and r.n_tokens == len(r.ids) // 4
        upto += r.n_tokens
    by_start = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert by_start == sorted(by_start, key=lambda x: -1 if x is None else x)


def test_reader_takes_only_the_frames_it_needs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FRAME_IDS", 50)
    path = f"file://{tmp_path}/one.tok"
    writer = token_files.Writer(path, 2)
    rng = np.random.default_rng(1)
    lengths = rng.integers(0, 40, 30)
    ids = rng.integers(0, 50000, lengths.sum()).astype(np.uint32)
    writer.add(ids, list(range(29)) + [None], lengths)
    writer.close()
    reader, ends, fetched = token_files.Reader(path), np.cumsum(lengths), []
    assert len(reader.frames[0]) > 5
    whole = reader.frame
    monkeypatch.setattr(reader, "frame", lambda k: fetched.append(k) or whole(k))
    assert reader.find(17)[0].tolist() == ids[ends[17] - lengths[17] : ends[17]].tolist() and len(fetched) == 1
    assert reader.find(None)[0].tolist() == ids[ends[29] - lengths[29] :].tolist()
    assert reader.find(99) == []
    # zstandard's own tools read the frames, and pass over the seek table
    import zstandard

    data = open(f"{tmp_path}/one.tok", "rb").read()
    raw = zstandard.ZstdDecompressor().stream_reader(data[:-16], read_across_frames=True).read()
    assert np.frombuffer(raw, "<u2").tolist() == ids.tolist()
    # damage is noticed
    data = bytearray(open(f"{tmp_path}/one.tok", "rb").read())
    data[int(reader.frames[0][2]) + 12] ^= 1
    open(f"{tmp_path}/one.tok", "wb").write(data)
    with pytest.raises(Exception):
        token_files.Reader(path).frame(2)


def check_packing(rows, ids_of, window):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.length == len(r.ids) // 4 and r.length <= window
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
    return by_sequence


def test_packing(spark, docs):
    encode = hf()
    rows = packing.pack(docs, JSON, window=128, added=True).collect()
    check_packing(rows, encode, 128)
    # Every document's ids are covered once: rows with one doc_id may be several documents.
    total = sorted((r.doc_id is not None, r.doc_id or 0, r.start, r.length) for r in rows)
    assert sum(x[3] for x in total) == sum(len(x[2]) + 1 for x in expected(encode))
    one = {r.start: np.frombuffer(r.ids, "<u4").tolist() for r in rows if r.doc_id == 5}
    assert sum((one[k] for k in sorted(one)), []) == [*encode(TEXTS[5]), 0]


@pytest.mark.parametrize("n", [1, 150])
def test_packing_wastes_little(spark, sf, n):
    """Also where each partition has a row or two."""
    rows = packing.pack(spark.read.parquet(f"{sf}/documents.parquet").repartition(n), JSON).collect()
    used = check_packing(rows, None, 1024)
    assert sum(r.length for r in rows) > 0.98 * 1024 * (len(used) - 1)


def test_best_fit_is_the_tightest():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 65, 300)
    which, offset, n = packing.best_fit_decreasing(lengths, 64)
    room, want = [], []
    for i in np.argsort(-lengths, kind="stable"):
        fits = [x for x in room if x >= lengths[i]]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - lengths[i])
        else:
            room.append(64 - lengths[i])
    fill = np.bincount(which, lengths, n)
    assert sorted(64 - fill) == sorted(room)
    assert packing.best_fit_decreasing(np.zeros(0, int), 64)[2] == 0


def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_like_tiktoken(spark, docs):
    codec = tik()
    got = bpe.decode(bpe.encode(docs, RANKS), RANKS).collect()
    assert sorted(((r.doc_id is not None, r.doc_id or 0, np.frombuffer(r.ids, "<u4").tolist()) for r in got), key=repr) == expected(codec.encode_ordinary)
    for r in got:
        assert r.decoded == codec.decode_bytes(np.frombuffer(r.ids, "<u4").tolist()) and r.n_tokens == len(r.ids) // 4


def test_bpe_small_blocks(spark, docs, monkeypatch):
    """Many blocks a partition give the same ids; the settings travel with the function."""
    small = docs.coalesce(1)
    a = {(r.doc_id, r.ids) for r in bpe.encode(small, RANKS).collect()}
    monkeypatch.setattr(bpe, "partitions", lambda s: 7)
    assert {(r.doc_id, r.ids) for r in bpe.encode(small, RANKS).collect()} == a


def test_bpe_many_blocks_a_partition(monkeypatch):
    monkeypatch.setattr(bpe.TaskContext, "get", classmethod(lambda c: type("Task", (), {"partitionId": lambda self: 5_000_000})()))
    numbers = [bpe.Block().number(i) for i in (0, 255, 256, 300, 900_000)]
    assert sorted(set(numbers)) == numbers and numbers[-1] < 2**63


def test_bpe_of_a_shuffled_table(spark, docs, sf):
    from tracelake.llm.common import replayable, texts

    scan = texts(spark.read.parquet(f"{sf}/documents.parquet")).where("doc_id > 3")
    assert replayable(scan, "x") is scan and replayable(docs, "x") is not docs and replayable(scan.distinct(), "x") is not scan


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert token_files.read_token_files(token_files.write_token_files(none, JSON)).count() == 0
    assert packing.pack(none, JSON).count() == 0
    assert bpe.decode(bpe.encode(none, RANKS), RANKS).count() == 0


def test_queries(spark, sf):
    from tracelake.llm import queries as q

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    encode, start = hf(), 0
    ids = {k: np.array([*encode(v), 0], "<u4") for k, v in docs.items()}
    got = {r.doc_id: r for r in q.op1_token_files(spark, sf).collect()}
    for k in sorted(ids):
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (start, len(ids[k]), zlib.crc32(ids[k].tobytes()))
        start += len(ids[k])
    for r in q.op2_packing(spark, sf).collect():
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    codec = tik()
    for r in q.op7_bpe(spark, sf).collect():
        want = codec.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(want) and r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
