"""Helpers shared by the training-data operators: shared storage, whole-text Arrow maps, tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Characters of text handed to a Python function at once; longer single texts go alone.
CHUNK_CHARS = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Only where that setting is missing (a local test session) a temporary folder is made.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='palimpsest-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write a table in the shared folder and read it back.

    A lost executor then costs only its own tasks; nothing before the table runs again.
    """
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    _MADE.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Paths written in this session, for scratch().
_MADE: list[str] = []


@contextmanager
def scratch(spark: SparkSession):
    """Delete what is written inside, but for the last table, once the block is done. Yields a function that also drops a table of an earlier block."""
    start, more = len(_MADE), []
    yield more.append
    for path in [*_MADE[start:-1], *more]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _MADE[start:-1] = []


def last_written() -> str:
    return _MADE[-1]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(texts: list[str | None], most: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most `most` characters, at least one row each."""
    lo, chars = 0, 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if i > lo and chars + n > most:
            yield lo, i
            lo, chars = i, 0
        chars += n
    if texts:
        yield lo, len(texts)


def map_texts(
    docs: DataFrame,
    make: Callable[[], Callable[[list[str | None]], list]],
    extra: T.StructType,
    keep: list[str],
    text_col: str = "text",
) -> DataFrame:
    """Append columns computed from whole texts, without a shuffle.

    `make()` runs once a task and returns a function from a list of texts to one array for each
    field of `extra`. `keep` names the columns that are carried along.
    """
    cols = keep if text_col in keep else [*keep, text_col]
    at = cols.index(text_col)
    fields = [docs.schema[c] for c in keep]
    schema = T.StructType([*fields, *extra.fields])
    names, n_keep = schema.names, len(keep)

    def run(batches):
        work = make()
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for lo, hi in pieces(texts):
                made = work(texts[lo:hi])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(lo, hi - lo) for i in range(n_keep)] + [x if isinstance(x, pa.Array) else pa.array(x) for x in made], names=names
                )

    return docs.select(*cols).mapInArrow(run, schema)


def schema_of(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)
