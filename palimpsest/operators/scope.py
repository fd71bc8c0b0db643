"""Spaces, scopes and anchors. A record without the rows its scope needs is out of scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.memory import Memory
from palimpsest.operators.temporal import entity_versions, fact_versions, visible_episodes
from palimpsest.plans.requests import Scope, Temporal, space_of


def anchored(anchors: tuple[str, ...], *ids: Column, lists: tuple[Column, ...] = ()) -> Column:
    """Any of the ids is an anchor; always, without anchors."""
    if not anchors:
        return F.lit(True)
    out = F.lit(False)
    for c in ids:
        out = out | F.coalesce(c.isin(*anchors), F.lit(False))
    for c in lists:
        out = out | F.coalesce(F.arrays_overlap(F.array_compact(c), F.array(*map(F.lit, anchors))), F.lit(False))
    return out


def fact_anchored(anchors: tuple[str, ...]) -> Column:
    return anchored(anchors, F.col("id"), F.col("subject_id"), F.col("object_id"), lists=(F.col("supporting_episode_ids"),))


def scoped_episodes(memory: Memory, episodes: DataFrame, scope: Scope) -> DataFrame:
    """Episodes whose source exists in their own space and passes the scope."""
    kinds = memory.sources.where(F.col("kind").isin(*scope.source_kinds)) if scope.source_kinds else memory.sources
    own = kinds.select(F.col("id").alias("source_id"), "space_id")
    if scope.group_ids:
        episodes = episodes.where(F.col("group_id").isin(*scope.group_ids))
    if scope.source_ids:
        episodes = episodes.where(F.col("source_id").isin(*scope.source_ids))
    return episodes.join(own, ["source_id", "space_id"], "left_semi").select(memory.episodes.columns)


def scoped_facts(memory: Memory, facts: DataFrame, scope: Scope, t: Temporal) -> DataFrame:
    """Facts of the statuses and entity types wanted, with a visible supporting episode in scope."""
    if scope.fact_status:
        facts = facts.where(F.col("status").isin(*scope.fact_status))
    columns = facts.columns
    if scope.entity_types:
        typed = entity_versions(memory, t, F.col("type").isin(*scope.entity_types)).select("id")
        for side in ("subject", "object"):
            facts = facts.join(typed.select(F.col("id").alias(f"{side}_id"), F.lit(True).alias(f"_{side}")), f"{side}_id", "left")
        facts = facts.where(F.coalesce("_subject", "_object", F.lit(False))).select(columns)
    if scope.by_episode:
        allowed = scoped_episodes(memory, visible_episodes(memory, t), scope).select(F.col("id").alias("_episode"))
        supported = facts.select("id", F.explode("supporting_episode_ids").alias("_episode")).join(allowed, "_episode", "left_semi")
        facts = facts.join(supported.select("id").distinct(), "id", "left_semi").select(columns)
    return facts


def facts_for(memory: Memory, space_id: str, scope: Scope, t: Temporal, only: Column | None = None) -> DataFrame:
    """The facts of a space that a request may see, of those for which `only` holds (see fact_versions)."""
    own = F.col("space_id") == space_of(space_id)
    return scoped_facts(memory, fact_versions(memory, t, own if only is None else own & only), scope, t)


def episodes_for(memory: Memory, space_id: str, scope: Scope, t: Temporal) -> DataFrame:
    return scoped_episodes(memory, visible_episodes(memory, t).where(F.col("space_id") == space_of(space_id)), scope)


def entities_for(memory: Memory, space_id: str, scope: Scope, t: Temporal) -> DataFrame:
    only = F.col("space_id") == space_of(space_id)
    return entity_versions(memory, t, only & F.col("type").isin(*scope.entity_types) if scope.entity_types else only)
