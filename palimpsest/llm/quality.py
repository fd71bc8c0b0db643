"""Quality classifier (operator 4): random-indexing word vectors, pooled, and a two-layer network.

A word in lower case hashes to one of `WORDS` rows, its shape (runs of upper, lower, digit; other
characters as they are) to one of `SHAPES`. Each row has a fixed sparse ternary index vector. The
vector of a word is the sum of the index vectors of the words beside it, over the sample, scaled
to length one (zero for a word that the sample lacks). A document is the mean of its words' vectors
and of its shapes' index vectors, over its whole text and `PRIOR` tokens of the average kind, which
steady short texts. A token equal to the one before has a shape of its own, REPEAT.
A network of one hidden layer and a logistic output is trained in numpy; its logits are divided by
a temperature that is fitted on rows set aside from the training rows.

The classifier is fitted on a bounded sample: about `sample_rows` labelled documents, chosen by a
hash of the id. Scoring covers all rows in one pass without a shuffle.

Results for odd rows: null and empty texts have the average vector and get its score; a document with
several labels (ties) counts as 1 if any of them is 1; null labels are left out; rows without an id
are scored, not held out and not learned from; repeated rows stay repeated, and each text of an id
that repeats is learned from; a text of many megabytes is pooled whole, and a single long word is one
word; with no label, or labels of one class only, the score is that class's share (0.5 with none); an
empty table gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import map_texts, schema_of, table, written
from palimpsest.llm.language_id import held_out
from palimpsest.llm.pretokens import Each

WORDS, SHAPES, DIM, NONZERO, REACH = 1 << 15, 1 << 12, 48, 6, 2
REPEAT, PRIOR = 0, 8
SAMPLE_ROWS, TASKS = 12_000, 6
MEMO_SIZE = 400_000
#: Tokens handled at once.
STEP = 50_000
HIDDEN, EPOCHS, SEED = 32, 40, 7
_RUNS = re.compile(r"(.)\1+")
_UPPER, _LOWER, _DIGIT = re.compile(r"[^\W\d_a-zß-öø-ÿ]+"), re.compile(r"[^\W\d_X]+"), re.compile(r"\d+")


def token_type(word: str) -> int:
    """The rows of a token's word and of its shape, as one number: word * SHAPES + shape."""
    low = word.lower().encode("utf-8", "replace")
    shape = _RUNS.sub(r"\1", _DIGIT.sub("9", _LOWER.sub("x", _UPPER.sub("X", word))))[:8]
    return zlib.crc32(low) % WORDS * SHAPES + zlib.crc32(shape.encode("utf-8", "replace")) % (SHAPES - 1) + 1


def types_memo() -> Each:
    return Each(token_type, MEMO_SIZE)


@functools.cache
def index_vectors(rows: int) -> np.ndarray:
    """Sparse ternary vectors, from a fixed seed."""
    rng = np.random.default_rng(SEED)
    out = np.zeros((rows, DIM), np.float32)
    at = rng.random((rows, DIM)).argsort(axis=1)[:, :NONZERO]
    out[np.arange(rows)[:, None], at] = np.where(rng.random((rows, NONZERO)) < 0.5, -1, 1)
    return out


def _flat(texts, memo) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words and shapes of all tokens, and the number of tokens of each text."""
    found = [t.split() if t else [] for t in texts]
    size = np.array([len(x) for x in found], np.int64)
    both = np.fromiter(map(memo.__getitem__, chain.from_iterable(found)), np.int64, int(size.sum()))
    word, shape = both // SHAPES, both % SHAPES
    again = np.r_[False, both[1:] == both[:-1]] if len(both) else np.empty(0, bool)
    ends = np.cumsum(size)
    again[(ends - size)[size > 0]] = False
    return word, np.where(again, REPEAT, shape), size


def _context(words: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sum over the tokens' neighbours of their index vectors, by the token's word."""
    index, out = index_vectors(WORDS), np.zeros((WORDS, DIM), np.float64)
    doc = np.repeat(np.arange(len(size)), size)
    for k in range(1, REACH + 1):
        same = np.nonzero(doc[:-k] == doc[k:])[0] if len(doc) > k else np.empty(0, np.int64)
        # Pairs are counted first, so that each distinct pair adds its vectors once.
        pair, n = np.unique(words[same] * WORDS + words[same + k], return_counts=True)
        for a, b in ((pair // WORDS, pair % WORDS), (pair % WORDS, pair // WORDS)):
            order = np.argsort(a, kind="stable")
            a, b, times = a[order], b[order], n[order, None]
            for lo in range(0, len(a), STEP):  # a word at a border is added in two parts
                own = a[lo : lo + STEP]
                starts = np.nonzero(np.r_[True, own[1:] != own[:-1]])[0]
                out[own[starts]] += np.add.reduceat(index[b[lo : lo + STEP]] * times[lo : lo + STEP], starts, axis=0)
    return out


def pool(texts: list[str | None], vectors: np.ndarray, prior: np.ndarray, memo) -> np.ndarray:
    """Mean vectors of each whole text's words and shapes, and of PRIOR average ones."""
    words, shapes, size = _flat(texts, memo)
    total = np.zeros((len(texts), 2 * DIM))
    doc = np.repeat(np.arange(len(size)), size)
    index = index_vectors(SHAPES)
    # In steps, so that the gathered rows stay small; a long text is summed in parts.
    for lo in range(0, len(doc), STEP):
        own = doc[lo : lo + STEP]
        starts = np.nonzero(np.r_[True, own[1:] != own[:-1]])[0]
        total[own[starts], :DIM] += np.add.reduceat(vectors[words[lo : lo + STEP]], starts, axis=0)
        total[own[starts], DIM:] += np.add.reduceat(index[shapes[lo : lo + STEP]], starts, axis=0)
    return ((total + PRIOR * prior) / (size[:, None] + PRIOR)).astype(np.float32)


class Network:
    """inputs -> tanh layer -> logit / temperature -> probability."""

    def __init__(self, mean, scale, w1, b1, w2, b2, temperature):
        self.mean, self.scale, self.w1, self.b1, self.w2, self.b2, self.temperature = mean, scale, w1, b1, w2, b2, temperature

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))

    @classmethod
    def constant(cls, width: int, share: float) -> Network:
        p = min(max(share, 1e-6), 1 - 1e-6)
        return cls(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), float(np.log(p / (1 - p))), 1.0)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, aside: np.ndarray) -> Network:
        """Trained by Adam on the rows not set aside; the temperature minimises the log loss of those aside."""
        rng = np.random.default_rng(SEED)
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        net = cls(mean, scale, rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), 0.0, 1.0)
        z, t = ((x - mean) / scale)[~aside], y[~aside].astype(float)
        params = [net.w1, net.b1, net.w2, np.array(net.b2)]
        moments, step = [(np.zeros_like(p), np.zeros_like(p)) for p in params], 0
        for _ in range(EPOCHS):
            for rows in np.array_split(rng.permutation(len(z)), max(1, len(z) // 128)):
                step += 1
                h = np.tanh(z[rows] @ params[0] + params[1])
                d = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -60, 60))) - t[rows]) / len(rows)
                back = np.outer(d, params[2]) * (1 - h * h)
                grads = [z[rows].T @ back + 1e-4 * params[0], back.sum(axis=0), h.T @ d + 1e-4 * params[2], d.sum()]
                for i, g in enumerate(grads):
                    m, v = moments[i]
                    moments[i] = m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                    params[i] = params[i] - 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3])
        if aside.any():
            logit, truth = net.logits(x[aside]), y[aside]
            losses = {c: np.logaddexp(0, np.where(truth == 1, -logit, logit) / c).mean() for c in np.geomspace(0.25, 8, 41)}
            net.temperature = float(min(losses, key=losses.get))
        return net


class QualityModel:
    def __init__(self, vectors: np.ndarray, prior: np.ndarray, network: Network):
        self.vectors, self.prior, self.network = vectors, prior, network

    def scorer(self):
        memo = types_memo()
        return lambda texts: self.network(pool(texts, self.vectors, self.prior, memo))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> QualityModel:
    """Fit on about `sample_rows` of the labelled rows for which `learn` (over the labels' id) holds."""
    spark = docs.sparkSession
    marked = labels.where(learn & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    n = marked.count()
    rate = min(1.0, sample_rows / max(1, n))
    part = F.pmod(F.xxhash64("id"), F.lit(1_000_003))
    chosen = marked.where(part / 1_000_003 < rate).groupBy("id").agg(F.max("y").alias("y"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # The sample is bounded by sample_rows: some 12 bytes a row.
    rows = texts.join(F.broadcast(chosen), "id").select("text", "y", (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(5)) == 0).alias("aside"))
    # A written table of bounded size, read by a fixed number of tasks: each returns one matrix.
    rows = written(rows, "quality-sample").coalesce(TASKS)

    def contexts(batches):
        memo, out, shaped = types_memo(), np.zeros((WORDS, DIM + 1)), np.zeros(SHAPES)
        for batch in batches:
            own = batch.column(0).to_pylist()
            for lo in range(0, len(own), 200):
                words, shapes, size = _flat(own[lo : lo + 200], memo)
                out[:, :DIM] += _context(words, size)
                out[:, DIM] += np.bincount(words, minlength=WORDS)
                shaped += np.bincount(shapes, minlength=SHAPES)
        yield pa.RecordBatch.from_arrays([pa.array([out.astype("<f4").tobytes()]), pa.array([shaped.tobytes()])], names=["m", "shapes"])

    context, shaped = np.zeros((WORDS, DIM + 1)), np.zeros(SHAPES)
    for r in rows.select("text").mapInArrow(contexts, "m binary, shapes binary").toLocalIterator():
        context += np.frombuffer(r["m"], "<f4").reshape(WORDS, DIM + 1)
        shaped += np.frombuffer(r["shapes"])
    context, times = context[:, :DIM], context[:, DIM]
    length = np.sqrt((context**2).sum(axis=1, keepdims=True))
    vectors = (context / np.maximum(length, 1e-9)).astype(np.float32)
    prior = (np.r_[times @ vectors, shaped @ index_vectors(SHAPES)] / max(1.0, times.sum())).astype(np.float32)
    shared = spark.sparkContext.broadcast(vectors)

    def pooled(batches):
        memo = types_memo()
        for batch in batches:
            x = pool(batch.column(0).to_pylist(), shared.value, prior, memo)
            yield pa.RecordBatch.from_arrays([pa.array([v.astype("<f4").tobytes() for v in x], pa.binary()), batch.column(1), batch.column(2)], names=["x", "y", "aside"])

    found = rows.mapInArrow(pooled, "x binary, y int, aside boolean").collect()
    shared.unpersist()
    y = np.array([r["y"] for r in found], np.int64)
    if len(set(y.tolist())) < 2:
        return QualityModel(vectors, prior, Network.constant(2 * DIM, float(y.mean()) if len(y) else 0.5))
    x = np.stack([np.frombuffer(r["x"], "<f4") for r in found]).astype(float)
    # A fixed order, whatever order the rows came in.
    order = np.lexsort([*x.T[:4], y])
    x, y, aside = x[order], y[order], np.array([r["aside"] for r in found])[order]
    if len(set(y[~aside].tolist())) < 2:
        aside = np.zeros(len(y), bool)
    return QualityModel(vectors, prior, Network.fit(x, y, aside))


def score(docs: DataFrame, model: QualityModel, *, keep: list[str], text_col: str = "text", prefix: str = "") -> DataFrame:
    """The kept columns with `score` and `predicted` (names get the prefix)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # WORDS vectors and the network

    def make():
        run = shared.value.scorer()

        def work(texts):
            p = run(texts)
            return [p, (p >= 0.5).astype(np.int32)]

        return work

    return map_texts(docs, make, schema_of(f"{prefix}score double, {prefix}predicted int"), keep, text_col)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = held_out("doc_id", 3, 1)
    model = fit(docs, table(spark, sf_dir, "labels"), ~out)
    return score(docs, model, keep=["doc_id"]).select("doc_id", out.alias("held_out"), "score", "predicted")
