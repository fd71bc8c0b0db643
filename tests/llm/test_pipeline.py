"""The corpus pipeline against its stages' operators one by one."""

import hashlib

import numpy as np
import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import byte_bpe, language_id, quality
from test_llm import fingerprint_by_force

SF = "/root/testdata/sf0.01"


def classes_by_force(text):
    """Least ids of the groups linked within 3 bits, or within 11 bits by sets of 5-word shingles of similarity 0.8."""
    ids = sorted(text)
    fps = [fingerprint_by_force(text[d]) for d in ids]
    sets = [frozenset(zip(*(w[i:] for i in range(5)), strict=False)) or frozenset([tuple(w)]) for d in ids for w in [text[d].lower().split()]]
    at = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            bits = (fps[i] ^ fps[j]).bit_count()
            if bits <= 3 or bits <= 11 and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = at[i], at[j]
                at = [min(a, b) if x == max(a, b) else x for x in at]
    return {ids[i] for i in at}


def test_stages_in_order_and_final_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit("own"))
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.written(stage(spark, before, SF), "stage")
        assert after.columns == docs.columns, name
        a, b = {r["doc_id"]: r for r in before.collect()}, {r["doc_id"]: r for r in after.collect()}
        assert all(a[k] == v for k, v in b.items()) and len(b) <= len(a)
        gone = [a[k]["text"] for k in a.keys() - b.keys()]
        if name.startswith("quality"):
            labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            bad = [k for k in a if labels.get(k) == 0]
            assert sum(k in b for k in bad) <= 0.2 * len(bad) and sum(labels.get(k) == 1 for k in a.keys() - b.keys()) <= 2
        if name.startswith("SimHash"):
            assert b.keys() == classes_by_force({k: r["text"] for k, r in a.items()})
        if name.startswith("benchmark"):
            items = [" ".join(r["text"].split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            holds = lambda t: any(i in " ".join(t.split()) for i in items)
            assert not any(holds(v["text"]) for v in b.values()) and all(map(holds, gone))
        before = after
    tik = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = {(k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()) for k, v in b.items() for ids in [tik.encode_ordinary(v["text"])]}
    last = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert {tuple(r)[:3] for r in last.collect()} == want
    whole = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in whole.collect()} == b.keys()


def test_stages_take_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "some words of a text", "en", "s", 20), (3, "some words of a text", "en", "s", 20), (3, "some words of a text", "en", "s", 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for given in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, given, SF)
            assert out.count() <= given.count(), name


def test_stages_take_clashing_columns_and_long_texts(spark):
    long = "these words make a text that goes on and on for many pages of a book " * 20_000
    rows = [(1, long, None, "s", 1, 0.5, 3, "x"), (2, long, "en", "s", 1, 0.6, 4, "y"), (3, "another short text of some plain words", "en", "s", 1, 0.7, 5, "z"), (4, "x" * 500_000, "en", "s", 1, 0.8, 6, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, hash int, component_id string")
    named = corpus_pipeline.language_stage(spark, docs, SF)
    assert named.columns == docs.columns and {r["doc_id"]: r["lang"] for r in named.collect()} == {1: "en", 2: "en", 3: "en", 4: "en"}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        kept = {r["doc_id"]: r for r in out.collect()}
        assert out.columns == docs.columns and all(kept[k]["component_id"] == r[7] and kept[k]["hash"] == r[6] for r in rows for k in [r[0]] if k in kept), name
        if name.startswith("SimHash"):
            assert set(kept) == {1, 3, 4}


def test_what_the_classifier_rejects_goes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), ~language_id.held_out("doc_id", 3, 1))
    want = {r["doc_id"] for r in quality.score(docs, model, keep=["doc_id"]).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in corpus_pipeline.quality_stage(spark, docs, SF).collect()} == want


def test_near_copies_of_wider_distance_go(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    sets = {k: frozenset(zip(*(w[i:] for i in range(5)), strict=False)) for k, t in text.items() for w in [t.lower().split()]}
    pair = next((a, b) for a in sets for b in sets if a < b and 0.8 <= len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b])) < 1)
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs.where(F.col("doc_id").isin(*pair)), SF).collect()}
    assert kept == {pair[0]}
