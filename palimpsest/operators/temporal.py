"""Which version of a record holds at a time, and whether it is visible then."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.memory import Memory
from palimpsest.plans import schema
from palimpsest.plans.requests import Temporal
from palimpsest.sources.shared import light, likely


def at(moment: datetime) -> Column:
    return F.lit(moment).cast("timestamp")


def valid_at(moment: Column) -> Column:
    """The validity [valid_from, valid_to) holds the moment; a missing end is open."""
    return (F.col("valid_from").isNull() | (F.col("valid_from") <= moment)) & (F.col("valid_to").isNull() | (moment < F.col("valid_to")))


def overlaps(a_from: Column, a_to: Column, b_from: Column, b_to: Column) -> Column:
    """Two half-open intervals with open missing ends have a moment in common."""
    apart = F.coalesce(a_to <= b_from, F.lit(False)) | F.coalesce(a_from >= b_to, F.lit(False))
    return ~apart


def observed_within(observed: Column, t: Temporal) -> Column:
    out = F.lit(True)
    if t.observed_from:
        out = out & (observed >= at(t.observed_from))
    if t.observed_to:
        out = out & (observed <= at(t.observed_to))
    return out


def fact_visible(t: Temporal) -> Column:
    out = observed_within(F.coalesce("observed_at", "created_at"), t)
    if t.as_of:
        out = out & (F.col("created_at") <= at(t.as_of))
    if not t.include_inactive:
        out = out & (F.col("status") == schema.ACTIVE)
    if t.valid_at:
        out = out & valid_at(at(t.valid_at))
    if t.valid_from or t.valid_to:
        none = F.lit(None).cast("timestamp")
        out = out & overlaps(F.col("valid_from"), F.col("valid_to"), at(t.valid_from) if t.valid_from else none, at(t.valid_to) if t.valid_to else none)
    return out


def latest_revisions(revisions: DataFrame, key: str, moment: datetime) -> DataFrame:
    """The last revision of each record known at the moment, as the record (ties: greater revision id).

    max_by combines on the map side: one row a record and task is shuffled, whatever the history's length.
    """
    record = [F.col(key).alias("id"), *(c for c in revisions.columns if c not in ("id", key, "revision_kind", "tx_time"))]
    known = revisions.where(F.col("tx_time") <= at(moment))
    best = known.groupBy(F.col(key).alias("key")).agg(F.max_by(F.struct(*record), F.struct("tx_time", "id")).alias("r"))
    return best.select("r.*")


def of_ids(memory: Memory, ids: DataFrame | str) -> Memory:
    """The memory with the facts and entities of these ids (a checkpoint's column `id`, or one id) only, and their revisions: none else is aggregated."""

    def own(df: DataFrame, key: str) -> DataFrame:
        if isinstance(ids, str):
            return df.where(F.col(key) == ids)
        few = light(ids)
        return likely(df, [key], ids).join(few.select(F.col("id").alias(key)).distinct(), key, "left_semi").select(df.columns)

    keys = {"facts": "id", "entities": "id", "fact_revisions": "fact_id", "entity_revisions": "entity_id"}
    return memory.with_tables(**{name: own(getattr(memory, name), key) for name, key in keys.items()})


def _versions(current: DataFrame, revised: DataFrame, moment: datetime, fallback: DataFrame | None = None) -> DataFrame:
    """Revisions where there are any; else the current record if it has not changed since."""
    rest = current.join(revised.select("id"), "id", "left_anti")
    out = revised.unionByName(rest.where(F.col("updated_at") <= at(moment)).select(revised.columns))
    return out if fallback is None else out.unionByName(fallback)


def fact_versions(memory: Memory, t: Temporal, only: Column | None = None) -> DataFrame:
    """Facts as of a time, visible under the other temporal filters.

    `only` may name columns that no write changes (space, predicate, subject, object); it is applied
    to the revisions before they are aggregated, so that it reaches the scan.
    """
    only = F.lit(True) if only is None else only
    facts = memory.facts.where(only)
    if not t.as_of:
        return facts.where(fact_visible(t))
    revised = latest_revisions(memory.fact_revisions.where(only), "fact_id", t.as_of)
    return _versions(facts, revised, t.as_of).where(fact_visible(t))


_HISTORY = "array<struct<changed_at:timestamp,space_id:string,namespace:string,type:string,canonical_name:string,aliases:array<string>>>"


def entity_versions(memory: Memory, t: Temporal, only: Column | None = None) -> DataFrame:
    """Entities as of a time, of those for which `only` holds (over space, namespace or type, which no write changes). Without a revision, a changed entity falls back on the earliest snapshot in its metadata that a later change replaced."""
    entities = memory.entities if only is None else memory.entities.where(only)
    if not t.as_of:
        return entities
    moment = at(t.as_of)
    revised = latest_revisions(memory.entity_revisions if only is None else memory.entity_revisions.where(only), "entity_id", t.as_of)
    current = entities.where(F.col("created_at") <= moment)
    changed = current.join(revised.select("id"), "id", "left_anti").where(F.col("updated_at") > moment)
    kept = F.from_json(F.get_json_object("metadata_json", "$._history"), _HISTORY)
    later = F.array_sort(F.filter(kept, lambda s: s["changed_at"] > moment), lambda a, b: F.when(a["changed_at"] < b["changed_at"], -1).when(a["changed_at"] > b["changed_at"], 1).otherwise(0))
    old = changed.withColumn("_h", kept).where(F.size("_h") > 0).withColumn("_s", F.try_element_at(later, F.lit(1)))
    named = ("space_id", "namespace", "type", "canonical_name", "aliases")
    old = old.withColumns({c: F.when(F.col("_s").isNull(), F.col(c)).otherwise(F.col(f"_s.{c}")) for c in named}).select(memory.entities.columns)
    return _versions(current, revised, t.as_of, old)


def visible_episodes(memory: Memory, t: Temporal) -> DataFrame:
    out = memory.episodes.where(observed_within(F.coalesce("observed_at", "ingested_at"), t))
    return out.where(F.col("ingested_at") <= at(t.as_of)) if t.as_of else out


def visible_sources(memory: Memory, t: Temporal) -> DataFrame:
    return memory.sources.where(F.col("created_at") <= at(t.as_of)) if t.as_of else memory.sources
