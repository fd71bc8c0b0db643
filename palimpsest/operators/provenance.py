"""Why a record is there: the nodes and edges that explain it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.errors import QUERY_FAILED, RecordError
from palimpsest.memory import Memory
from palimpsest.operators.temporal import entity_versions, fact_versions, of_ids, visible_episodes, visible_sources
from palimpsest.plans.requests import ProvenanceRequest, space_of
from palimpsest.sources.shared import cut, light

NODE = ["id", "type", "label", "meta"]
EDGE = ["id", "type", "from_id", "to_id"]
FACT = ["id", "predicate", "subject_id", "object_id", "status", "valid_from", "valid_to", "retracted_at", "retraction_reason", "supporting_episode_ids", "superseded_by", "supersedes", "supersede_reason"]


def fact_meta() -> Column:
    """Status, validity and lifecycle links as JSON, without those that are not set."""
    return F.to_json(F.struct("status", "valid_from", "valid_to", "retracted_at", "retraction_reason", "superseded_by", "supersedes", "supersede_reason"))


def _nodes(df: DataFrame, kind: str, label: str, meta: Column | None = None) -> DataFrame:
    return df.select("id", F.lit(kind).alias("type"), F.col(label).alias("label"), (meta if meta is not None else F.lit(None).cast("string")).alias("meta"))


def _edges(df: DataFrame, kind: Column | str, a: str, b: str, *parts: str, end: str = "") -> DataFrame:
    named = F.concat_ws(":", F.lit("prov"), *(F.col(p) for p in parts), *([F.lit(end)] if end else []))
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return df.select(named.alias("id"), kind.alias("type"), F.col(a).alias("from_id"), F.col(b).alias("to_id"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _distinct_nodes(parts: list[DataFrame]) -> DataFrame:
    """A node that comes with and without meta keeps its meta."""
    return _union(parts).groupBy("id").agg(F.max("type").alias("type"), F.max("label").alias("label"), F.max("meta").alias("meta"))


def provenance(memory: Memory, request: ProvenanceRequest) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) around a fact, an entity or an episode; empty where it is not visible in the space."""
    depth = request.max_depth if request.max_depth > 0 else 8
    t, space = request.temporal, F.col("space_id") == space_of(request.space_id)
    # Only the columns that nodes and edges are made of are read; contents never are.
    versions = lambda m: fact_versions(m, t, space).select(*FACT)
    episodes = visible_episodes(memory, t).select("id", "space_id", "kind", "source_id")
    if request.kind == "fact":
        return _of_fact(memory, request, versions, episodes, visible_sources(memory, t).where(space), depth)
    facts = versions(memory)
    if request.kind == "entity":
        return _of_entity(request, facts, episodes, entity_versions(memory, t, space), depth)
    if request.kind == "episode":
        return _of_episode(memory, request, facts, episodes.where(space), depth)
    raise RecordError(QUERY_FAILED, "unsupported provenance kind", kind=request.kind)


def _met(few: DataFrame, records: DataFrame) -> DataFrame:
    """Records by the column `id` of a few rows."""
    return records.join(light(few), "id")


def _of_fact(memory, request, versions, episodes, sources, depth):
    root = cut(versions(of_ids(memory, request.id)))
    fact_id = F.col("id").alias("fact_id")
    support = cut(_met(root.select(fact_id, F.explode(F.array_distinct("supporting_episode_ids")).alias("id")), episodes))
    nodes = [_nodes(root, "Fact", "predicate", fact_meta()), _nodes(support, "Episode", "kind")]
    edges = [_edges(support, "ASSERTS", "id", "fact_id", "id", "fact_id")]
    if depth >= 2:
        own = _met(support.select(F.col("id").alias("episode_id"), F.col("source_id").alias("id")), sources)
        nodes.append(_nodes(own, "Source", "kind"))
        edges.append(_edges(own, "FROM_SOURCE", "episode_id", "id", "id", "episode_id"))
    if not root.isEmpty():
        # What replaced this fact; what it superseded, by its own list and by what other facts say now.
        listed = root.select(F.explode("supersedes").alias("id"))
        named = memory.facts.where(F.col("superseded_by") == request.id).select("id")
        after = root.select(fact_id, F.col("superseded_by").alias("id")).where("id IS NOT NULL")
        before = cut(listed.unionByName(named).distinct())
        wanted = cut(before.unionByName(after.select("id")).distinct())
        # Both ways are looked up in one pass over the facts.
        found = cut(versions(of_ids(memory, wanted)))
        after, before = _met(after, found), _met(before, found).withColumn("fact_id", F.lit(request.id))
        nodes += [_nodes(after, "Fact", "predicate", fact_meta()), _nodes(before, "Fact", "predicate", fact_meta())]
        edges += [_edges(after, "SUPERSEDES", "id", "fact_id", "id", "fact_id", end="supersedes"), _edges(before, "SUPERSEDES", "fact_id", "id", "fact_id", "id", end="supersedes")]
    return _distinct_nodes(nodes).orderBy("id"), _union(edges).distinct().orderBy("id")


def _of_entity(request, facts, episodes, entities, depth):
    root = cut(entities.where(F.col("id") == request.id))
    own = facts.where((F.col("subject_id") == request.id) | (F.col("object_id") == request.id)).withColumn("entity_id", F.lit(request.id))
    own = cut(own.limit(0) if root.isEmpty() else own)
    nodes = [_nodes(root, "Entity", "canonical_name"), _nodes(own, "Fact", "predicate")]
    role = F.when(F.col("object_id") == request.id, "OBJECT").otherwise("SUBJECT")
    edges = [_edges(own, role, "id", "entity_id", "id", "entity_id")]
    if depth >= 2:
        fact_id = F.col("id").alias("fact_id")
        support = cut(_met(own.select(fact_id, F.explode(F.array_distinct("supporting_episode_ids")).alias("id")), episodes).select("fact_id", "id", "kind"))
        after = cut(_met(own.select(fact_id, F.col("superseded_by").alias("id")), facts))
        nodes += [_nodes(support, "Episode", "kind"), _nodes(after, "Fact", "predicate", fact_meta())]
        edges += [_edges(support, "ASSERTS", "id", "fact_id", "id", "fact_id"), _edges(after, "SUPERSEDES", "id", "fact_id", "id", "fact_id", end="supersedes")]
    return _distinct_nodes(nodes).orderBy("id"), _union(edges).distinct().orderBy("id")


def _of_episode(memory, request, facts, episodes, depth):
    root = cut(episodes.where(F.col("id") == request.id))
    own = cut(_met(root.select(F.col("id").alias("episode_id"), F.col("source_id").alias("id")), memory.sources))
    held = facts.where(F.array_contains("supporting_episode_ids", request.id)).withColumn("episode_id", F.lit(request.id))
    held = cut(held.limit(0) if root.isEmpty() else held)
    nodes = [_nodes(root, "Episode", "kind"), _nodes(own, "Source", "kind"), _nodes(held, "Fact", "predicate")]
    edges = [_edges(own, "FROM_SOURCE", "episode_id", "id", "episode_id", "id"), _edges(held, "ASSERTS", "episode_id", "id", "episode_id", "id")]
    return _distinct_nodes(nodes).orderBy("id"), _union(edges).distinct().orderBy("id")
