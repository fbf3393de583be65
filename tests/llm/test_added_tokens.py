"""Added tokens of the tokenizer against the library's own call."""

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tracelake.llm import queries
from tracelake.llm.tokens import encoder

JSON = public_tokenizers.path("byte_bpe_50k.json")
END = "<|endoftext|>"
TEXTS = ["before", f"a {END} b", END, f"{END}{END}", f" {END}\n\n x  {END}", "<|endoftext |> <|endof", f"don't{END}'s é中文", "", "after"]


def test_ids_like_the_library():
    ids, lengths = encoder(JSON).encode(TEXTS, None, added=True)
    want = [Tokenizer.from_file(JSON).encode(t, add_special_tokens=False).ids for t in TEXTS]
    assert ids.tolist() == sum(want, []) and lengths.tolist() == list(map(len, want)) and want[1] == [64, 220, 50256, 275]
    assert 50256 not in encoder(JSON).encode(TEXTS, None)[0]


def test_queries_encode_added_tokens(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    library, start = Tokenizer.from_file(JSON), 0
    ids = [np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4") for t in TEXTS]
    got = {r.doc_id: r for r in queries.op1_token_files(spark, str(tmp_path)).collect()}
    for i, x in enumerate(ids):
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(x), zlib.crc32(x.tobytes()))
        start += len(x)
    for r in queries.op2_packing(spark, str(tmp_path)).collect():
        assert (r.start, r.doc_tokens, r.ids_crc32) == (0, len(ids[r.doc_id]), zlib.crc32(ids[r.doc_id].tobytes()))
    assert {r.doc_id: bytes(r.ids) for r in corpus_pipeline.packing_stage(spark, docs, str(tmp_path)).collect()} == {i: x.tobytes() for i, x in enumerate(ids)}
