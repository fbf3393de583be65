"""The text index's trigrams: a row for each of a block, and the same hits as a scan on odd texts."""

import pyarrow as pa

from tracelake.operators import search, text_index


def test_a_block_has_a_row_a_trigram(spark, tmp_path):
    rows = spark.range(2000).selectExpr("id", "'the same station' AS text").coalesce(1)
    text_index.build(rows, f"file://{tmp_path}", "id", "text", 1, 0, buckets=2, parts=1)
    index = text_index.opened(spark, f"file://{tmp_path}")
    assert index.table(spark, "grams").count() <= 14 * 4  # 28,000 when each text had its own
    assert text_index.candidates(spark, index, "tion").count() == 2000 == text_index.phrase_hits(spark, index, "tion").count()


def test_odd_texts_and_identities_as_in_a_scan(spark, tmp_path):
    odd = ["a\0\0b", "\0\0\0", "😀😁😀x", "İstanbul TION", "", None, "ab", "字字字字tion", "a" * 70 + "tiontion", "tio ion"]
    rows = spark.createDataFrame([(f"k{i}", t) for i, t in enumerate(odd)], "name string, text string")
    text_index.build(rows, f"file://{tmp_path}", "name", "text", 1, 0, buckets=4, parts=4)
    index = text_index.opened(spark, f"file://{tmp_path}")
    for phrase in ("tion", "\0\0\0", "😀😁😀", "字字字", "a\0\0", "stanbul"):
        hits = lambda df: sorted((r.name, round(r.score, 9)) for r in df.collect())
        assert hits(text_index.phrase_hits(spark, index, phrase)) == hits(search.phrase_hits(rows, "text", phrase)), phrase


def test_pieces_and_blocks_lose_and_repeat_nothing(monkeypatch):
    monkeypatch.setattr(text_index, "PIECE", 5)
    monkeypatch.setattr(text_index, "BLOCK", 10)
    texts = ["abcabcabc xyz abc" * 3, None, "", "xy", "xyz", "zyx" * 30, "a😀b😀c"] * 4
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["id", "low"])
    out = list(text_index._postings(iter([batch, batch.slice(0, 0)])))
    got = [(g, i) for b in out for g, ids in zip(*[c.to_pylist() for c in b.columns]) for i in ids]
    want = {(t[k : k + 3], i) for i, t in enumerate(texts) if t for k in range(len(t) - 2)}
    assert len(out) > 2 and len(got) == len(set(got)) and set(got) == want
