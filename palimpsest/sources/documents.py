"""JSON batches in, exports out, plain text files as episodes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.errors import INPUT_INVALID, LIFECYCLE_INVALID, RecordError
from palimpsest.memory import Memory
from palimpsest.operators.lifecycle import ingest_batch
from palimpsest.plans import schema
from palimpsest.sources.shared import exists, with_numbers

_META = "metadata string"
SOURCE = "source struct<id string, space_id string, kind string, uri string, external_ref string, metadata string>"
EPISODE = f"id string, space_id string, kind string, content string, source_id string, {SOURCE}, group_id string, observed_at timestamp, {_META}"
ENTITY = f"id string, space_id string, namespace string, type string, canonical_name string, stable_key string, aliases array<string>, {_META}"
FACT = f"id string, space_id string, predicate string, subject_id string, object_id string, value_text string, confidence double, status string, valid_from timestamp, valid_to timestamp, observed_at timestamp, supporting_episode_ids array<string>, cardinality string, {_META}"
PARTS = {"episodes": EPISODE, "entities": ENTITY, "facts": FACT}
REVISIONS = ("entity_revisions", "fact_revisions")
#: What an export adds to the fields above; imported records get their own.
_EXTRA = {"created_at", "updated_at", "ingested_at", "duplicate_of", "retracted_at", "retraction_reason", "superseded_by", "supersedes", "supersede_reason"}


def read_batch(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The parts of a batch, each with `pos`; fields that are not known are refused.

    A folder holds JSON lines in subfolders named like the parts (as an export does): it is read in
    parallel, whatever its size. A file is one document with lists of the parts, or JSON lines of
    such documents.
    """
    if not path.endswith((".json", ".jsonl")):
        return _read_folder(spark, path)
    docs = spark.read.text(path, wholetext=path.endswith(".json")).where(F.trim("value") != "")
    known = F.array(*(F.lit(k) for k in (*PARTS, "sources", "entity_revisions", "fact_revisions")))
    odd = docs.select(F.array_except(F.coalesce(F.json_object_keys("value"), F.array(F.lit("?"))), known).alias("odd")).where(F.size("odd") > 0).head(1)
    if odd:
        raise RecordError(INPUT_INVALID, "unknown field in batch", field=sorted(odd[0]["odd"])[0])
    for name in REVISIONS:
        if not docs.where(F.size(F.from_json(F.get_json_object("value", f"$.{name}"), "array<string>")) > 0).isEmpty():
            raise RecordError(LIFECYCLE_INVALID, "revisions cannot be imported")
    docs = with_numbers(docs.withColumn("file", F.input_file_name()).withColumn("line", F.monotonically_increasing_id()), ["file", "line"], "doc")
    parts = {}
    for name, ddl in PARTS.items():
        raw = docs.select("doc", F.posexplode(F.from_json(F.get_json_object("value", f"$.{name}"), "array<string>")).alias("at", "row"))
        _refuse_unknown(raw, name, ddl)
        numbered = with_numbers(raw, ["doc", "at"], "pos")
        parts[name] = _flat(numbered.select("pos", F.from_json("row", ddl).alias("r")).select("pos", "r.*").withColumnRenamed("metadata", "metadata_json"), name)
    return parts


def _refuse_unknown(raw: DataFrame, name: str, ddl: str) -> None:
    known = F.array(*(F.lit(k) for k in ({f.name for f in T._parse_datatype_string(ddl).fields} | _EXTRA)))
    odd = raw.select(F.array_except(F.coalesce(F.json_object_keys("row"), F.array(F.lit("?"))), known).alias("odd")).where(F.size("odd") > 0).head(1)
    if odd:
        raise RecordError(INPUT_INVALID, f"unknown field in {name}", field=sorted(odd[0]["odd"])[0])


def _flat(rows: DataFrame, name: str) -> DataFrame:
    """An episode's own source as columns."""
    if name != "episodes":
        return rows
    flat = {f"source_{c}": F.col(f"source.{c}") for c in ("kind", "uri", "external_ref", "space_id")}
    return rows.withColumn("source_id", F.coalesce("source_id", "source.id")).withColumns(flat).withColumn("source_metadata_json", F.col("source.metadata")).drop("source")


def _read_folder(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    for name in REVISIONS:
        if exists(spark, f"{path}/{name}") and not spark.read.text(f"{path}/{name}").isEmpty():
            raise RecordError(LIFECYCLE_INVALID, "revisions cannot be imported")
    parts = {}
    for name, ddl in PARTS.items():
        if not exists(spark, f"{path}/{name}"):
            continue
        raw = spark.read.text(f"{path}/{name}").withColumnRenamed("value", "row")
        known = ddl + ", metadata_json string"
        _refuse_unknown(raw, name, known)
        rows = raw.select(F.from_json("row", known).alias("r")).select("r.*")
        rows = _flat(rows.withColumn("metadata_json", F.coalesce("metadata_json", "metadata")).drop("metadata"), name)
        parts[name] = with_numbers(rows, ["id"], "pos")
    if "episodes" in parts and exists(spark, f"{path}/sources"):
        # Exported episodes name their source; what it was comes from the table of sources.
        own = spark.read.schema(schema.SOURCES).json(f"{path}/sources")
        own = own.select(F.col("id").alias("source_id"), "space_id", *(F.col(c).alias(f"_{c}") for c in ("kind", "uri", "external_ref", "metadata_json")))
        rows = parts["episodes"].join(own, ["source_id", "space_id"], "left")
        kept = {f"source_{c}": F.coalesce(f"source_{c}", f"_{c}") for c in ("kind", "uri", "external_ref", "metadata_json")}
        parts["episodes"] = rows.withColumns(kept).drop("_kind", "_uri", "_external_ref", "_metadata_json")
    return parts


def ingest_json(memory: Memory, path: str, now: datetime) -> Memory:
    return ingest_batch(memory, now, **read_batch(memory.spark, path))


def text_episodes(spark: SparkSession, path: str, *, kind: str = "document", space_id: str = "") -> DataFrame:
    """One episode a file, with the file as its source."""
    files = spark.read.text(path, wholetext=True).select(F.col("value").alias("content"), F.input_file_name().alias("source_uri"))
    rows = with_numbers(files, ["source_uri"], "pos")
    return rows.select("content", "source_uri", F.col("source_uri").alias("source_external_ref"), F.lit("file").alias("source_kind"), F.lit(kind).alias("kind"), F.lit(space_id).alias("space_id"), "pos")


def exported(memory: Memory, *, importable: bool = False) -> dict[str, DataFrame]:
    """The tables in id order. An importable export has no revisions and only active facts, without lifecycle fields."""
    tables = dict(memory.tables())
    if importable:
        tables.pop("fact_revisions")
        tables.pop("entity_revisions")
        life = {"status": F.lit(None).cast("string"), "superseded_by": F.lit(None).cast("string"), "supersedes": F.lit(None).cast("array<string>"), "supersede_reason": F.lit(None).cast("string")}
        tables["facts"] = tables["facts"].where(F.col("status") == schema.ACTIVE).withColumns(life)
    return {name: df.orderBy("id") for name, df in tables.items()}


def write_export(memory: Memory, path: str, *, importable: bool = False) -> None:
    """One folder of JSON lines a table; an importable one is a batch that ingest_json() reads."""
    for name, df in exported(memory, importable=importable).items():
        df.write.mode("overwrite").json(f"{path}/{name}")
