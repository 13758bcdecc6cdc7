"""The pipeline's stages by their effects, and whole runs against the pieces by brute force."""

import hashlib

import numpy as np
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
import public_tokenizers as P
from schemaloom.llm import bpe
from tests.llm.test_duplicates import groups

FOLDER = "/root/testdata/sf0.001"


def test_registered():
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard", "decontamination", "secret_scan", "byte_bpe"]


def test_run_equals_brute_force(spark):
    docs = [r.asDict() for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    bench = [" ".join(r["text"].lower().split()) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    first = {d: c for d, _, c in groups([(r["doc_id"], r["text"]) for r in docs])}
    kept = [r for r in docs if first[r["doc_id"]] == r["doc_id"]]
    kept = [r for r in kept if not any(b in " ".join(r["text"].lower().split()) for b in bench)]
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert set(got) == {r["doc_id"] for r in kept}
    assert all(r["round_trip"] for r in got.values())
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(bpe.VOCABULARY), special_tokens={})
    clean = 0
    for r in kept:
        ids = np.array(encoding.encode_ordinary(r["text"]), "<u4").tobytes()
        text = encoding.decode(np.frombuffer(bytes(got[r["doc_id"]]["token_ids"]), "<u4").tolist())
        assert text == r["text"] or "[" in text
        clean += text == r["text"] and got[r["doc_id"]]["ids_sha256"] == hashlib.sha256(ids).hexdigest()
    assert clean > 0.8 * len(kept)


def test_stages_take_odd_rows(spark):
    docs = spark.createDataFrame(
        [(None, None, None, None, None, 1), (1, "", "en", "s", 0, 2), (2, "a word of text", "en", None, 14, 3), (2, "a word of text", "en", None, 14, 3),
         (3, "token=abcdefgh12 and words", None, "s", 26, 4), (4, "words " * 5000, "en", "s", 30000, 5)],
        "doc_id long, text string, lang string, source string, n_chars long, extra int")
    for empty in (False, True):
        rows = docs.limit(0) if empty else docs
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, FOLDER)
            if name != "byte_bpe":
                assert out.columns == docs.columns
                rows = out
        if empty:
            assert out.count() == 0
        else:
            assert {r["doc_id"] for r in out.collect()} == {2, 3, 4} and out.where("doc_id = 2").count() == 1
            red = rows.where("doc_id = 3").first()
            assert red["text"] == "[assign] and words" and red["n_chars"] == len(red["text"])


def test_one_posterior_for_copies(spark):
    docs = spark.createDataFrame([(i, t, k, None, None) for i, (t, k) in enumerate([("the cat sat", "en"), ("die katze sitzt", "de"), ("123", "en")])],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.identify_language(spark, docs, FOLDER)
    assert {r["doc_id"] for r in kept.collect()} == {0, 1}
    assert kept.where(F.col("lang").isNull()).count() == 0
