"""Cutting a plan short in the folder that the driver and the executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. A local session without that setting gets a temporary folder; a cluster must name one."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='palimpsest-')}"
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def with_numbers(df: DataFrame, by: list[str] | list[Column], name: str) -> DataFrame:
    """The rows with their number from 0 in the order of `by`, in a column of that name.

    Rows are dealt in ranges of the order and checkpointed; a range's first number comes from the
    counts of the ranges before it, one row a partition. No task sees more than its range.
    """
    ranged = cut(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33).cast("int")
    counts = {r["part"]: r["n"] for r in ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    starts, total = [], 0
    for k in sorted(counts):
        starts += [F.lit(k), F.lit(total).cast("long")]
        total += counts[k]
    if not starts:
        return ranged.withColumn(name, F.col("_place")).drop("_place")
    within = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1).cast("long"))
    return ranged.withColumn(name, F.create_map(*starts)[part] + within).drop("_place")


#: Rows that a join sends to all tasks at most.
LIGHT = 100_000


#: Ids that a filter sends to all tasks at most, as hashes of 8 bytes.
HASHED = 4_000_000


def light(df: DataFrame, most: int | None = None) -> DataFrame:
    """Rows of a checkpoint, marked for broadcast if they are few enough: `most` of them, where that is known and few, else counted first."""
    few = df.limit(LIGHT + 1).count() if most is None or most > LIGHT else most
    return F.broadcast(df) if few <= LIGHT else df


def likely(df: DataFrame, columns: list[str], ids: DataFrame, most: int | None = None) -> DataFrame:
    """The rows with one of the columns among the ids (a checkpoint's column `id`), and perhaps some others: hashes may clash.

    For a join that would shuffle all of `df` for ids too many to be sent themselves: it still follows, over what is left.
    """
    n = ids.count() if most is None or most > LIGHT else most
    if not LIGHT < n <= HASHED:
        return df
    hashed, marks = ids.select(F.xxhash64("id").alias("_k")).distinct(), []
    for i, c in enumerate(columns):
        marks.append(f"_m{i}")
        df = df.join(F.broadcast(hashed.select(F.col("_k").alias(f"_k{i}"), F.lit(True).alias(f"_m{i}"))), F.xxhash64(c) == F.col(f"_k{i}"), "left")
    return df.where(F.coalesce(*marks)).drop(*marks, *(f"_k{i}" for i in range(len(columns))))


#: Words of 64 bits that a sieve has at most.
WORDS = 1 << 20


def sieve(df: DataFrame, name: str, n: int) -> Callable[[Column], Column]:
    """A test of hashes (xxhash64) that holds for all values in a column of `n` rows and for few others: at most 8 MB are sent to a task, whatever `n`.

    One bit a value and little code a test: a filter whose code is too long for the JVM to compile takes ten times as long.
    The test does not go into lambda functions.
    """
    size = 1 << min(max(n // 4, 1).bit_length(), WORDS.bit_length() - 1)
    at = lambda h: F.shiftright(h, 6).bitwiseAND(F.lit(size - 1)).cast("int")
    place = lambda h: h.bitwiseAND(F.lit(63)).cast("int")
    h = F.xxhash64(name)
    held = df.select(at(h).alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), place(h)).alias("word"))
    held = held.unionByName(df.sparkSession.range(size).selectExpr("CAST(id AS int) AS at", "0L AS word"))
    words = held.groupBy("at").agg(F.bit_or("word").alias("word")).agg(F.array_sort(F.collect_list(F.struct("at", "word")))["word"].alias("words"))
    known = cut(words).scalar()
    return lambda h: F.getbit(F.get(known, at(h)), place(h)) == 1


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    return hadoop, at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file under its name at once: written beside it, then renamed over it."""
    hadoop, at, fs = _fs(spark, path)
    staged = hadoop.Path(at.getParent(), f".{at.getName()}-{uuid.uuid4().hex[:8]}")
    stream = fs.create(staged, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    option = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    option[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(fs.getUri()).rename(fs.makeQualified(staged), fs.makeQualified(at), option)


def exists(spark: SparkSession, path: str) -> bool:
    _, at, fs = _fs(spark, path)
    return fs.exists(at)


def get_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, or nothing where there is none."""
    return spark.read.text(path, wholetext=True).first()[0] if exists(spark, path) else None
