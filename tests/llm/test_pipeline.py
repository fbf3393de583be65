"""The pipeline against brute force, stage by stage."""

import re
from itertools import combinations

import numpy as np
import public_tokenizers
from test_dedup import brute_components, brute_fingerprint
from tokenizers import Tokenizer

import corpus_pipeline
from tracelake.llm import pii, quality


def test_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = {r.doc_id for r in quality.score(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 1").collect()}
    rows = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id in good}
    groups = {}
    for i, t in rows.items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append((-len(t), i))
    rows = {min(g)[1]: rows[min(g)[1]] for g in groups.values()}
    fps = {i: brute_fingerprint(t) for i, t in rows.items()}
    linked = [(a, b) for a, b in combinations(sorted(rows), 2) if (fps[a] ^ fps[b]).bit_count() <= 4]
    rows = {i: rows[i] for i, root in brute_components(sorted(rows), linked).items() if i == root}
    made = pii.Pseudonyms(pii.session_key(spark))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: [*tokenizer.encode(pii.pseudonymised(t, made)[0], add_special_tokens=False).ids, 0] for i, t in rows.items()}
    got = {}
    for r in corpus_pipeline.run(spark, sf).collect():
        got.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    assert {i: sum((x for _, x in sorted(p)), []) for i, p in got.items()} == want


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns


def test_odd_tables_end_to_end(spark, sf, tmp_path):
    """Null ids, null and empty texts, repeated rows, columns with the stages' own names; an empty table."""
    texts = ["Mail a.b@example.com or 10.1.2.3 about the long report of the year", None, "", "same words here for all", "same  words here for all", "x " * 5000]
    rows = [(None if i == 3 else i, t, "en", i, f"k{i}", i) for i, t in enumerate(texts)] + [(5, texts[5], "en", 5, "k5", 5), (None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, h long, key string, kept_id long")
    spark.read.parquet(f"{sf}/labels.parquet").where("quality = 0").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # Without positives in the fold nothing is rejected; one of each group of equal texts stays.
    assert {r.doc_id for r in pieces} == {0, 1, 4, 5} and sum(r.length for r in pieces if r.doc_id == 1) == 1
    docs.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_intermediates_are_deleted(spark, sf):
    from tracelake.llm import common

    begun = common.mark()
    corpus_pipeline.run(spark, sf).count()
    assert len(common._made) - begun == 2  # the last stage's input, and its first pass
    common.clean(spark)
