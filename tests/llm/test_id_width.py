"""Ids beyond 65,535 in token files."""

import json

import numpy as np
import public_tokenizers
import pytest

from tracelake.llm import token_files

JSON = public_tokenizers.path("byte_bpe_50k.json")


def test_writer_refuses_ids_that_do_not_fit(tmp_path):
    ids = np.array([1, 70_000], np.uint32)
    writer = token_files.Writer(f"file://{tmp_path}/a.tok", 2)
    with pytest.raises(ValueError, match="70000"):
        writer.add(ids, [1], np.array([2]))
        writer.close()
    writer = token_files.Writer(f"file://{tmp_path}/b.tok", 4)
    writer.add(ids, [1], np.array([2]))
    writer.close()
    assert token_files.Reader(f"file://{tmp_path}/b.tok").find(1)[0].tolist() == [1, 70_000]


def test_width_follows_the_vocabulary(spark, tmp_path):
    with open(JSON, encoding="utf-8") as f:
        large = json.load(f)
    large["added_tokens"][0]["id"] = large["model"]["vocab"][large["added_tokens"][0]["content"]] = 70_000
    (tmp_path / "large.json").write_text(json.dumps(large), encoding="utf-8")
    docs = spark.createDataFrame([(1, "<|endoftext|>")], "doc_id long, text string")
    for path, want in ((JSON, [50256, 0]), (str(tmp_path / "large.json"), [70_000, 0])):
        row = token_files.read_token_files(token_files.write_token_files(docs, path, added=True)).first()
        assert np.frombuffer(row.ids, "<u4").tolist() == want
