"""Counts, invariants, duplicates and their repair."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.errors import INPUT_INVALID, RecordError
from palimpsest.functions.text import folded, strip, text_or_empty
from palimpsest.memory import Memory
from palimpsest.operators.lifecycle import retract_facts, upsert_entities
from palimpsest.plans import schema


def inspect_counts(memory: Memory) -> DataFrame:
    parts = [getattr(memory, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "n") for name in ("sources", "episodes", "entities", "facts")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def inspect_schema(memory: Memory) -> dict[str, str]:
    return {name: df.schema.simpleString() for name, df in memory.tables().items()}


def unsupported_facts(memory: Memory) -> DataFrame:
    """Active facts without a supporting episode that exists: there should be none."""
    active = memory.facts.where(F.col("status") == schema.ACTIVE)
    held = active.select("id", F.explode_outer("supporting_episode_ids").alias("e")).join(memory.episodes.select(F.col("id").alias("e")), "e", "left_semi")
    return active.join(held.select("id").distinct(), "id", "left_anti")


def unmarked(entities: DataFrame) -> DataFrame:
    return entities.where(strip(text_or_empty("duplicate_of")) == "")


def _pairs(records: DataFrame, key: list[Column]) -> DataFrame:
    """(target_id, source_id): each record of a key but the least id, with that id. No row holds a whole group."""
    keyed = records.select("id", *key)
    names = [c for c in keyed.columns if c != "id"]
    groups = keyed.groupBy(*names).agg(F.min("id").alias("target_id"), F.count("*").alias("n")).where("n > 1")
    same = [keyed[c].eqNullSafe(groups[c]) for c in names]
    return keyed.join(groups, same).where("id <> target_id").select("target_id", F.col("id").alias("source_id"))


def _entity_key() -> list[Column]:
    return [folded(text_or_empty(c)).alias(f"_{c}") for c in ("space_id", "namespace", "type", "canonical_name")]


def _fact_key() -> list[Column]:
    key = [folded(text_or_empty(c)).alias(f"_{c}") for c in ("space_id", "predicate", "subject_id", "object_id", "value_text")]
    return [*key, F.array_join(F.array_sort("supporting_episode_ids"), ",").alias("_support"), F.col("valid_from").alias("_from"), F.col("valid_to").alias("_to")]


def entity_duplicate_pairs(memory: Memory) -> DataFrame:
    return _pairs(unmarked(memory.entities), _entity_key())


def fact_duplicate_pairs(memory: Memory) -> DataFrame:
    return _pairs(memory.facts.where(F.lower("status") != schema.RETRACTED), _fact_key())


def entity_duplicates(memory: Memory) -> DataFrame:
    """(target_id, source_ids, namespace, type, canonical_name): entities of one name, in lower case; the least id is the target."""
    key = _entity_key()
    shown = F.min_by(F.struct("namespace", "type", "canonical_name"), "id")
    groups = unmarked(memory.entities).groupBy(*key).agg(F.array_sort(F.collect_list("id")).alias("ids"), shown.alias("shown")).where(F.size("ids") > 1)
    return groups.select(F.col("ids")[0].alias("target_id"), F.slice("ids", 2, F.size("ids") - 1).alias("source_ids"), "shown.*")


def fact_duplicates(memory: Memory) -> DataFrame:
    """(target_id, source_ids, predicate, subject_id, object_id, value_text): facts that say the same on the same grounds, unless retracted."""
    key = _fact_key()
    shown = F.min_by(F.struct("predicate", "subject_id", "object_id", "value_text"), "id")
    groups = memory.facts.where(F.lower("status") != schema.RETRACTED).groupBy(*key).agg(F.array_sort(F.collect_list("id")).alias("ids"), shown.alias("shown")).where(F.size("ids") > 1)
    return groups.select(F.col("ids")[0].alias("target_id"), F.slice("ids", 2, F.size("ids") - 1).alias("source_ids"), "shown.*")


def merge_entities(memory: Memory, pairs: DataFrame, now: datetime, *, confirm: bool) -> Memory:
    """Mark `source_id` as a duplicate of `target_id` and fold its names into the target's aliases; facts stay where they are."""
    if not confirm:
        raise RecordError(INPUT_INVALID, "merging entities must be confirmed")
    own = memory.entities
    folded_in = pairs.join(own.withColumnRenamed("id", "source_id"), "source_id").groupBy("target_id").agg(F.flatten(F.sort_array(F.collect_list(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))))).alias("more"))
    keep = ["space_id", "namespace", "type", "canonical_name"]
    targets = own.join(folded_in, own["id"] == folded_in["target_id"]).select("id", *keep, F.col("more").alias("aliases"), F.lit(None).cast("string").alias("duplicate_of"), F.lit(0).alias("pos"))
    marked = own.join(pairs, own["id"] == pairs["source_id"]).select("id", *keep, F.col("aliases"), F.col("target_id").alias("duplicate_of"), F.lit(1).alias("pos"))
    return upsert_entities(memory, targets.unionByName(marked), now)


def compact(memory: Memory, now: datetime, *, apply: bool = False, confirm: bool = False) -> tuple[DataFrame, DataFrame, Memory]:
    """(entity groups, fact groups, memory): with `apply`, duplicate entities are marked and duplicate facts retracted."""
    entities, facts = entity_duplicates(memory), fact_duplicates(memory)
    if not apply:
        return entities, facts, memory
    if not confirm:
        raise RecordError(INPUT_INVALID, "compaction must be confirmed")
    after = merge_entities(memory, entity_duplicate_pairs(memory), now, confirm=True)
    gone = fact_duplicate_pairs(memory).select(F.col("source_id").alias("id"), F.concat(F.lit("duplicate_of:"), "target_id").alias("reason"), F.lit(0).alias("pos"))
    return entities, facts, retract_facts(after, gone, None, now)
