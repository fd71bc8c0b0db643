"""A durable memory: tables by space, and a log that says which folder of each space is current.

    {table}/space_id={space}/version={folder}/...   rows, written once and never changed
    _log/{n}.json                              for each table: space -> folder

A commit writes the rows of the spaces that it changed, and only then its log entry, by a rename
that does not overwrite: of two writers that began at one version the second is refused, and a
write that fails leaves the version before it. The log entry is the filter of a read, over
partition columns, so other versions and spaces are not opened. Folders and the log go through
Hadoop's file systems, local or not. One row a space meets the driver.
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.errors import CONFIG_INVALID, LIFECYCLE_INVALID, NOT_SUPPORTED, RecordError
from palimpsest.memory import Memory
from palimpsest.operators.lifecycle import seed_revisions
from palimpsest.plans import schema

_LOG = "_log"
#: Rows of a file at most: short rows pack well, and a file or two of many would be read by a task or two.
FILE_ROWS = 100_000
#: Spaces that a task writes side by side. Rows of more are sorted first, and wide rows spill then.
WRITERS = 8


def digests(df: DataFrame) -> dict[str, tuple]:
    """For each space the number of rows and a sum of their hashes: one pass, combined where rows are read."""
    # Hashes of maps are refused, so tables hold none.
    own = F.xxhash64(*df.columns).cast("decimal(20,0)")
    return {r["space_id"]: (r["n"], str(r["h"])) for r in df.groupBy("space_id").agg(F.count("*").alias("n"), F.sum(own).alias("h")).collect()}


@contextmanager
def _setting(spark: SparkSession, name: str, value: str):
    """A setting of the session for a while."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


class Store:
    """Open a folder, or with `in_memory` keep nothing beyond the session."""

    def __init__(self, spark: SparkSession, path: str = "", *, in_memory: bool = False, read_only: bool = False):
        if bool(path) == in_memory:
            raise RecordError(CONFIG_INVALID, "give either a path or in_memory")
        self.spark, self.path, self.read_only = spark, path.rstrip("/"), read_only
        self._memory = Memory.empty(spark) if in_memory else None

    def _fs(self):
        jvm, path = self.spark._jvm, self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm.org.apache.hadoop.fs, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> str | None:
        """Name of the current version, or nothing in a new folder."""
        hadoop, fs = self._fs()
        log = hadoop.Path(f"{self.path}/{_LOG}")
        names = [f.getPath().getName() for f in fs.listStatus(log)] if fs.exists(log) else []
        return max((n.removesuffix(".json") for n in names if n.endswith(".json") and not n.startswith(".")), default=None)

    def log(self, version: str | None = None) -> dict[str, dict[str, dict]]:
        """table -> space -> {version, rows, digest} of a version, the current one by default."""
        name = version or self.version()
        if name is None:
            return {table: {} for table in schema.TABLES}
        return json.loads(self.spark.read.text(f"{self.path}/{_LOG}/{name}.json", wholetext=True).first()[0])

    def load(self, version: str | None = None) -> Memory:
        """The state of a version, the current one by default."""
        if self._memory is not None:
            return self._memory
        log = self.log(version)
        return Memory(**{table: self._read(table, s, log[table]) for table, s in schema.TABLES.items()})

    def _read(self, table: str, columns: T.StructType, spaces: dict[str, dict]) -> DataFrame:
        if not spaces:
            return self.spark.createDataFrame([], columns)
        whole = T.StructType([*columns.fields, T.StructField("version", T.StringType())])
        current = F.create_map(*(F.lit(x) for space, at in spaces.items() for x in (space, at["version"])))
        return self.spark.read.schema(whole).parquet(f"{self.path}/{table}").where(F.col("version") == current[F.col("space_id")]).select(columns.names)

    def _written(self, table: str, columns: T.StructType, folder: str) -> dict[str, tuple]:
        hadoop, fs = self._fs()
        if not fs.exists(hadoop.Path(f"{self.path}/{table}")):
            return {}
        whole = T.StructType([*columns.fields, T.StructField("version", T.StringType())])
        return digests(self.spark.read.schema(whole).parquet(f"{self.path}/{table}").where(F.col("version") == folder).select(columns.names))

    def table(self, name: str) -> DataFrame:
        """One table of the current version."""
        return getattr(self._memory, name) if self._memory is not None else self._read(name, schema.TABLES[name], self.log()[name])

    def save(self, memory: Memory, *, base: str | None = None, whole: bool = False, only: tuple[str, ...] = tuple(schema.TABLES)) -> str:
        """Write the spaces that differ from the current version (or all) and make that the next one. Returns its name.

        `base` is the version that the memory was made from, the current one by default; if another
        one is current when the log is written, nothing changes and the write is refused. Tables
        that `only` leaves out stay as they are there, and are not asked of the memory.
        """
        if self.read_only:
            raise RecordError(NOT_SUPPORTED, "the store is open for reading only")
        if self._memory is not None:
            self._memory = self._memory.with_tables(**{table: getattr(memory, table) for table in only})
            return "memory"
        hadoop, fs = self._fs()
        held = base or self.version()
        before = self.log(held)
        name = f"v{int((held or 'v00000000')[1:]) + 1:08d}"
        folder = f"{name}-{uuid.uuid4().hex[:8]}"

        def one(table: str) -> dict[str, dict]:
            columns = schema.TABLES[table]
            df = getattr(memory, table).select(columns.names)

            def put(rows: DataFrame) -> None:
                rows.withColumn("version", F.lit(folder)).write.mode("append").option("maxRecordsPerFile", FILE_ROWS).option("compression", "zstd").partitionBy("space_id", "version").parquet(f"{self.path}/{table}")

            if not before[table] or whole:  # nothing to compare with: written first, counted where it lies
                put(df)
                return {space: {"version": folder, "rows": n, "digest": h} for space, (n, h) in self._written(table, columns, folder).items()}
            own = digests(df)
            log = {space: before[table][space] for space, (n, h) in own.items() if space in before[table] and [n, h] == [before[table][space]["rows"], before[table][space]["digest"]]}
            if changed := [space for space in own if space not in log]:
                put(df.where(F.col("space_id").isin(*changed)))
            return log | {space: {"version": folder, "rows": own[space][0], "digest": own[space][1]} for space in changed}

        # The tables are independent: their jobs run side by side.
        with _setting(self.spark, "spark.sql.maxConcurrentOutputFileWriters", str(WRITERS)), ThreadPoolExecutor(len(only)) as pool:
            log = before | dict(zip(only, pool.map(one, only), strict=True))
        staged, entry = hadoop.Path(f"{self.path}/{_LOG}/.{folder}"), hadoop.Path(f"{self.path}/{_LOG}/{name}.json")
        stream = fs.create(staged, True)
        stream.write(bytearray(json.dumps(log).encode()))
        stream.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri())
        option = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        option[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(fs.makeQualified(staged), fs.makeQualified(entry), option)
        except Exception as e:
            fs.delete(staged, False)
            if not fs.exists(entry):
                raise
            raise RecordError(LIFECYCLE_INVALID, "another write was committed first", version=name) from e
        return name

    def commit(self, write, *args, **kwargs) -> Memory:
        """Apply a write of operators.lifecycle to the current state and save the result once, or nothing."""
        if self.read_only:
            raise RecordError(NOT_SUPPORTED, "the store is open for reading only")
        base = None if self._memory is not None else self.version()
        self.save(write(self.load(base), *args, **kwargs), base=base)
        return self.load()

    def migrate(self) -> Memory:
        """Seed revisions for records without any; a second call changes nothing."""
        return self.commit(seed_revisions)

    def checkpoint(self) -> str:
        """Every space's rows in one new folder each, without the small files of many commits."""
        base = None if self._memory is not None else self.version()
        return self.save(self.load(base), base=base, whole=True)


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, change) of the rows that differ: created, updated or deleted. Support lists compare as sets."""

    def row(df: DataFrame, name: str) -> DataFrame:
        same = [F.array_sort(c).alias(c) if c == "supporting_episode_ids" else F.col(c) for c in sorted(df.columns) if c != "id"]
        return df.select("id", F.struct(*same).alias(name))

    met = row(before, "a").join(row(after, "b"), "id", "full_outer").where("NOT (a <=> b)")
    return met.select("id", F.when(F.col("a").isNull(), "created").when(F.col("b").isNull(), "deleted").otherwise("updated").alias("change"))
