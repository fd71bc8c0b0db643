"""Token counts (operator 9): pieces are counted once per distinct pre-token of the whole table.

Three steps:

1. Each task counts its texts' pre-tokens; the counts meet by pre-token, and each distinct one goes
   to the vocabulary's library once. That dictionary (pre-token, occurrences, pieces) is a table.
2. The `head` most frequent pre-tokens, a bounded number of bounded length, are sent to all tasks.
   Each document's frequency table is joined to them where its text is read, and summed; what the
   head lacks stays with the document as a short list.
3. Those lists are joined to the dictionary by a shuffle and summed by document. A pre-token in
   them is rarer than all of the head, so none is hot.

So texts are never shuffled, frequencies only of rare pre-tokens, and ids are never kept. With the
head every size behaves alike: it only decides which of two joins a pre-token takes. A vocabulary
without a rule to split texts by (.model: its pieces may cross spaces) has whole texts as
pre-tokens; these are counted where they are read.

Results for odd rows: a null or empty text has 0 bytes and 0 tokens; repeated rows and ids (ties)
stay repeated, each with its own count; a text of many megabytes, or one word of that length, is
counted whole; an empty table gives an empty table; other columns of the input are ignored,
whatever their names.
"""

from __future__ import annotations

from collections import Counter
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import map_texts, pieces, schema_of, table, written
from palimpsest.llm.pretokens import word_pieces, words

#: Bytes of a task's dictionary of pieces, and pre-tokens that a task counts before it hands them on.
MEMO_BYTES, HELD = 32 << 20, 200_000
#: Pre-tokens that go to all tasks, and the most characters of one: 20 MB at most.
HEAD, HEAD_CHARS = 200_000, 40


def frequencies(texts: DataFrame, held: int = HELD) -> DataFrame:
    """(token, n): occurrences of each distinct pre-token of a column of texts."""

    def run(batches):
        count: Counter = Counter()

        def made():
            return pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["token", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    count.update(words(text))
                if len(count) >= held:
                    yield made()
                    count.clear()
        if count:
            yield made()

    return texts.mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def dictionary(texts: DataFrame, vocabulary: str, *, held: int = HELD, memo_bytes: int = MEMO_BYTES) -> DataFrame:
    """(token, n, pieces): every distinct pre-token, its occurrences and its number of tokens, in a table of its own."""

    def run(batches):
        memo = word_pieces(vocabulary, len, sum, memo_bytes).words
        for batch in batches:
            for lo in range(0, batch.num_rows, 10_000):
                part = batch.slice(lo, 10_000)
                new = part.column(0).to_pylist()
                get = memo.hold(new).__getitem__
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([get(w) for w in new], pa.int64())], names=["token", "n", "pieces"])

    return written(frequencies(texts, held).mapInArrow(run, "token string, n long, pieces long"), "dictionary")


def _joined(docs: DataFrame, known: DataFrame, id_col: str, text_col: str, head: int) -> DataFrame:
    """(id, n_bytes, n_tokens) by the head where texts are read, and by a shuffled join for the rest."""
    spark = docs.sparkSession
    # Bounded by `head` rows of HEAD_CHARS characters.
    top = known.where(F.char_length("token") <= HEAD_CHARS).orderBy(F.desc("n"), "token").limit(head).select("token", "pieces").toArrow()
    shared = spark.sparkContext.broadcast(dict(zip(top.column(0).to_pylist(), top.column(1).to_pylist(), strict=True)))
    schema = T.StructType([docs.schema[id_col], *schema_of("n_bytes long, n_head long, rest array<string>, times array<long>").fields])

    def run(batches):
        own = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in pieces(texts):
                n, size, rest, times = [], [], [], []
                for t in texts[lo:hi]:
                    c = Counter(words(t)) if t else {}
                    found = [own.get(w) for w in c]
                    if None in found:
                        left = [w for w, k in zip(c, found, strict=True) if k is None]
                        rest.append(left)
                        times.append([c[w] for w in left])
                        found = [k or 0 for k in found]
                    else:
                        rest.append(None)
                        times.append(None)
                    n.append(sum(map(mul, c.values(), found)) if c else 0)
                    size.append(len(t.encode()) if t else 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(rest, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int64()))], names=schema.names
                )

    rows = docs.select(id_col, text_col).mapInArrow(run, schema)
    # Ids may repeat or be missing, so rows get numbers of their own, fixed by the table.
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "head-counts")
    rest = rows.where("rest IS NOT NULL").select("row", F.explode(F.arrays_zip("rest", "times")).alias("x"))
    rest = rest.select("row", F.col("x.rest").alias("token"), F.col("x.times").alias("times"))
    more = rest.join(known.select("token", "pieces"), "token").groupBy("row").agg(F.sum(F.col("times") * F.col("pieces")).alias("more"))
    return rows.join(more, "row", "left").select(id_col, "n_bytes", (F.col("n_head") + F.coalesce("more", F.lit(0))).alias("n_tokens"))


def _whole(docs: DataFrame, vocabulary: str, id_col: str, text_col: str) -> DataFrame:
    """The same for a sentencepiece file, whose pre-token is the whole text."""

    def make():
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary)

        def work(texts):
            return [np.array([len(t.encode()) if t else 0 for t in texts], np.int64), np.array([len(sp.encode(t)) if t else 0 for t in texts], np.int64)]

        return work

    return map_texts(docs, make, schema_of("n_bytes long, n_tokens long"), [id_col], text_col)


def count_tokens(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, head: int = HEAD, held: int = HELD) -> DataFrame:
    """One row a document: its id, UTF-8 bytes, tokens, and whether these are more than `limit`.

    `vocabulary` is the path of a .json (tokenizers) or .model (sentencepiece) file that every
    executor can read. No special tokens are added; nothing is truncated.
    """
    if vocabulary.endswith(".model"):
        found = _whole(docs, vocabulary, id_col, text_col)
    else:
        found = _joined(docs, dictionary(docs.select(text_col), vocabulary, held=held), id_col, text_col, head)
    return found.select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return count_tokens(table(spark, sf_dir, "documents"), P.path("word_bpe_49k.json"))
