"""Operators that SQL cannot express against plain versions of their methods."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import ann, decontaminate, language_id, quality, sharding
from palimpsest.llm.common import written

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts(spark):
    return [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]


# --- 2: packing
def test_packing_by_force():
    rng = np.random.default_rng(0)
    items = rng.integers(1, 400, (300, 3)) ** rng.integers(1, 3, (300, 1))
    weights, shards = sharding.WEIGHTS, 7
    total = items.sum(axis=0)
    residual = [[1.0] * 3 for _ in range(shards)]
    want = [0] * len(items)
    for i in sorted(range(len(items)), key=lambda i: (-max(items[i] / total), i)):
        share = [x / t * shards for x, t in zip(items[i], total, strict=True)]
        fit = [sum(w * r * s for w, r, s in zip(weights, room, share, strict=True)) for room in residual]
        want[i] = fit.index(max(fit))
        residual[want[i]] = [r - s for r, s in zip(residual[want[i]], share, strict=True)]
    assert sharding.pack(items, shards).tolist() == want


def test_all_three_sizes_are_balanced(spark, texts):
    rows = sharding.op2_sharding(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), "doc_id").collect()
    shard = [r["shard"] for r in rows]
    bytes_, tokens = [len(r["text"].encode()) + 1 for r in rows], [len(r["text"].split()) for r in rows]
    for sizes, most in ((bytes_, 1.01), (tokens, 1.03), ([1] * len(rows), 1.1)):
        sums = np.bincount(shard, weights=sizes, minlength=8)
        assert sums.max() <= most * sums.mean() and sums.min() >= (2 - most) * sums.mean()


# --- 3: recall with the shipped parameters
def test_ann_recall_of_many_lists(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(200, 32))
    x = (centres[rng.integers(0, 200, 50_000)] + rng.normal(size=(50_000, 32))).astype(np.float32)
    df = spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "vec_id long, embedding array<float>").repartition(8)
    got = ann.nearest(df, F.col("id") % 500 == 0).toPandas()
    x = x.astype(float)
    hits = 0
    queries = range(0, 50_000, 500)
    for q in queries:
        s = x @ x[q]
        s[q] = -np.inf
        least = np.partition(s, -20)[-20]
        own = got[got.query_id == q]
        assert sorted(own["rank"]) == list(range(1, 21)) and np.allclose(own.score, x[own.vec_id] @ x[q])
        hits += int((own.score >= least - 1e-9).sum())
    assert hits / (20 * len(queries)) >= 0.9


# --- 4: word vectors, pooling, training, calibration
def test_word_vectors_by_force():
    texts = ["The cat sat on the mat", "a cat", "", None, "mat mat mat on"]
    words, shapes, size = quality._flat(texts, quality.types_memo())
    assert size.tolist() == [6, 2, 0, 0, 4] and shapes.tolist().count(quality.REPEAT) == 2
    word = lambda w: quality.token_type(w) // quality.SHAPES
    assert words.tolist() == [word(w) for t in texts if t for w in t.split()] and word("The") == word("the") != word("cat")
    index, want = quality.index_vectors(quality.WORDS), np.zeros((quality.WORDS, quality.DIM))
    for t in texts:
        own = (t or "").split()
        for i, w in enumerate(own):
            for j in range(max(0, i - quality.REACH), min(len(own), i + quality.REACH + 1)):
                if j != i:
                    want[word(w)] += index[word(own[j])]
    got = quality._context(words, size)
    assert np.allclose(got, want)
    prior = np.full(2 * quality.DIM, 0.5, np.float32)
    pooled = quality.pool(texts, got.astype(np.float32), prior, quality.types_memo())
    for i, t in enumerate(texts):
        both = [np.r_[want[word(w)], np.zeros(quality.DIM)] for w in (t or "").split()]
        total = sum(both, np.zeros(2 * quality.DIM))[: quality.DIM]
        assert np.allclose(pooled[i, : quality.DIM], (total + quality.PRIOR * 0.5) / (len(both) + quality.PRIOR), atol=1e-5)


def test_network_learns_and_is_calibrated():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 8))
    p = 1 / (1 + np.exp(-2 * np.tanh(x[:, 0] * x[:, 1]) - x[:, 2]))
    y = (rng.random(6000) < p).astype(int)
    aside = np.arange(6000) % 5 == 0
    net = quality.Network.fit(x[:4000], y[:4000], aside[:4000])
    score, truth = net(x[4000:]), y[4000:]
    loss = lambda s: -np.mean(np.log(np.where(truth == 1, s, 1 - s)))
    assert loss(score) < loss(np.full(2000, truth.mean())) - 0.05
    for lo in (0.0, 0.25, 0.5, 0.75):
        own = (score >= lo) & (score < lo + 0.25)
        assert own.sum() > 50 and abs(score[own].mean() - truth[own].mean()) < 0.12
    logit = net.logits(x[:4000][aside[:4000]])
    of = lambda c: np.logaddexp(0, np.where(y[:4000][aside[:4000]] == 1, -logit, logit) / c).mean()
    assert of(net.temperature) <= of(1.0) + 1e-12


# --- 6: out-of-place distance
def plain_ranks(text, top):
    letters = [c if c.isalpha() else " " for c in text]
    words = "".join(x.lower() if len(x.lower()) == 1 else x for x in letters).split()
    count = Counter()
    for w in words:
        padded = f"\1{w}\1"
        count.update(w)
        count.update(padded[i : i + 2] for i in range(len(padded) - 1))
        count.update(padded[i : i + 3] for i in range(len(padded) - 2))
    code = lambda g: sum(ord(c) << 16 * (len(g) - 1 - k) for k, c in enumerate(g))
    by = {code(g): n for g, n in count.items()}
    return {c: r for r, c in enumerate(sorted(by, key=lambda c: (-by[c], c))[:top])}


def test_out_of_place_distance_by_force(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    profiles = language_id.fit_profiles(docs, ~language_id.held_out("doc_id", 4, 2))
    ranks = {name: {int(c): int(r) for c, r in zip(profiles.codes, profiles.ranks[:, k], strict=True) if r >= 0} for k, name in enumerate(profiles.languages)}
    some = texts[:150] + ["x", "1 2 3", "Ünïcode straße ÀÉ"]
    names, scores = profiles.predict(some)
    for text, name, score in zip(some, names, scores, strict=True):
        own = plain_ranks(text, profiles.top)
        if not own:
            assert (name, score) == ("und", 0)
            continue
        away = {k: sum(abs(r - held[c]) if c in held else profiles.top for c, r in own.items()) for k, held in ranks.items()}
        best = min(sorted(away), key=away.get)
        assert name == best and abs(score - max(0, 1 - away[best] / (profiles.top * len(own)))) < 1e-9


# --- 8: latent space and candidates
def _items(spark, texts):
    rows = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect()]
    return decontaminate.Items(rows)


def test_latent_space_and_candidates_by_force(spark, texts):
    items = _items(spark, texts)
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    terms = decontaminate.term_rows(rows, items)
    decontaminate._fit(terms, items)
    packed = [r["terms"] for r in terms.orderBy("id").collect()]
    n = len(items.number)
    gram = np.zeros((n, n))
    for _, own, size in decontaminate.unpacked(packed, items.code):
        a = decontaminate.Passages(own, size).sums(own, np.eye(n, dtype=np.float32), items.idf)
        gram += a.T.astype(float) @ a
    basis = items.basis.astype(float)
    assert np.allclose(basis.T @ basis, np.eye(basis.shape[1]), atol=1e-3)
    values = np.linalg.eigvalsh(gram)[::-1]
    held = np.trace(basis.T @ gram @ basis)
    assert held >= 0.85 * values[: basis.shape[1]].sum()  # one pass of a randomised SVD, lifted towards the items
    found, every = set(), set()
    finder = decontaminate.Finder(items)
    plain = decontaminate.Finder(items)
    plain._candidates = lambda _, p: ((np.arange(p.n_blocks), np.full(p.n_blocks, k), np.zeros(p.n_blocks)) for k in range(len(items.terms)))
    for lo, own, size in decontaminate.unpacked(packed, items.code):
        found |= {(lo + d, k) for d, k, *_ in finder(own, size)}
        every |= {(lo + d, k) for d, k, *_ in plain(own, size)}
    assert len(every) > 20 and found <= every and len(found) >= 0.9 * len(every)


def test_written_tables_keep_their_rows(spark):
    assert written(spark.range(10).toDF("x"), "t").count() == 10
