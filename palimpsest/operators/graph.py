"""The graph that records span, and breadth-first neighbourhoods in it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.errors import INPUT_INVALID, RecordError
from palimpsest.memory import Memory
from palimpsest.operators.scope import episodes_for, facts_for
from palimpsest.operators.temporal import entity_versions, visible_sources
from palimpsest.plans.requests import NeighborhoodRequest, Scope, Temporal, space_of
from palimpsest.sources.shared import cut, light, likely

#: Hops that one request may ask for: each is a job of the driver's loop.
MOST_HOPS = 16


def _node(kind: str, label: str):
    return [F.col("id"), F.lit(kind).alias("type"), F.col(label).alias("label")]


def _edge(edge_id, kind: str, a, b):
    return F.struct(edge_id.alias("id"), F.lit(kind).alias("type"), a.alias("from_id"), b.alias("to_id"))


def _parts(memory: Memory, space_id: str, scope: Scope, t: Temporal) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges), where an ASSERTS edge may name an episode that does not exist."""
    episodes, facts = episodes_for(memory, space_id, scope, t), facts_for(memory, space_id, scope, t)
    if t.as_of or scope.by_episode or scope.entity_types:  # aggregated or joined: once, not for each hop
        facts = cut(facts.select("id", "predicate", "subject_id", "object_id", "supporting_episode_ids"))
        episodes = cut(episodes.select("id", "kind", "source_id"))
    in_space = F.col("space_id") == space_of(space_id)
    nodes = (
        entity_versions(memory, t, in_space).select(*_node("Entity", "canonical_name"))
        .unionByName(visible_sources(memory, t).where(in_space).select(*_node("Source", "kind")))
        .unionByName(episodes.select(*_node("Episode", "kind")))
        .unionByName(facts.select(*_node("Fact", "predicate")))
    )
    word, own = F.lit("edge:"), F.col("id")
    from_source = episodes.where("source_id <> ''").select(_edge(F.concat(word, own, F.lit(":source")), "FROM_SOURCE", own, F.col("source_id")).alias("e"))
    ends = F.array(
        _edge(F.concat(word, own, F.lit(":subject")), "SUBJECT", own, F.col("subject_id")),
        F.when(F.col("object_id") != "", _edge(F.concat(word, own, F.lit(":object")), "OBJECT", own, F.col("object_id"))),
    )
    supports = F.transform(F.coalesce("supporting_episode_ids", F.array().cast("array<string>")), lambda ep: _edge(F.concat(word, own, F.lit(":"), ep), "ASSERTS", ep, own))
    # One pass over the facts makes all their edges.
    of_facts = facts.select(F.explode(F.array_compact(F.concat(ends, supports))).alias("e"))
    return nodes, from_source.unionByName(of_facts).select("e.*")


def graph(memory: Memory, space_id: str = "", scope: Scope | None = None, temporal: Temporal | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a space at a time.

    Entities and sources are not scoped. An episode that supports a fact gives an edge if it
    exists, visible or not.
    """
    nodes, edges = _parts(memory, space_id, scope or Scope(), temporal or Temporal())
    asserts = edges.where("type = 'ASSERTS'").join(memory.episodes.select(F.col("id").alias("from_id")), "from_id", "left_semi")
    return nodes, edges.where("type <> 'ASSERTS'").unionByName(asserts.select(edges.columns))


def _incident(edges: DataFrame, memory: Memory, frontier: DataFrame, most: int) -> tuple[DataFrame, int]:
    """(edges with an end in a frontier of at most `most` ids, a bound of their number); only of these, episodes are checked to exist."""
    ends, edges = light(frontier, most), likely(edges, ["from_id", "to_id"], frontier, most)
    for end in ("from_id", "to_id"):
        edges = edges.join(ends.select(F.col("id").alias(end), F.lit(True).alias(f"_{end}")), end, "left")
    met = cut(edges.where("_from_id OR _to_id").select("id", "type", "from_id", "to_id").distinct())
    n = met.count()
    asserts = met.where("type = 'ASSERTS'")
    claimed = cut(asserts.select(F.col("from_id").alias("id")).distinct())
    held = cut(likely(memory.episodes.select("id"), ["id"], claimed, n).join(light(claimed, n), "id").select(F.col("id").alias("from_id")).distinct())
    held = light(held, n)
    return met.where("type <> 'ASSERTS'").unionByName(asserts.join(held, "from_id", "left_semi").select(met.columns)), n


def neighborhood(memory: Memory, request: NeighborhoodRequest) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) within some hops of the anchors, by undirected breadth-first search.

    Edge types are filtered on the way, node types in the result; an edge stays if both ends do.
    `max_nodes` keeps the first nodes by id, after the edges were chosen. Each hop is one pass over
    facts and episodes that keeps the edges at the frontier: edges are made and dropped in the same
    task, and the frontier is sent to all tasks while it is small.
    """
    if not request.anchor_ids:
        raise RecordError(INPUT_INVALID, "anchor_ids must not be empty")
    if request.max_hops > MOST_HOPS:
        raise RecordError(INPUT_INVALID, f"max_hops must not exceed {MOST_HOPS}", max_hops=request.max_hops)
    nodes, edges = _parts(memory, request.space_id, request.scope, request.temporal)
    allowed = edges.where(F.col("type").isin(*request.edge_types)) if request.edge_types else edges
    frontier = cut(nodes.where(F.col("id").isin(*request.anchor_ids)).select("id").distinct())
    reached, touched, most = frontier, None, len(request.anchor_ids)
    total = most
    for _ in range(max(1, request.max_hops)):
        met, n = _incident(allowed, memory, frontier, most)
        met = cut(met)
        touched = met if touched is None else touched.unionByName(met)
        ends = met.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
        frontier, most = cut(ends.join(reached, "id", "left_anti")), 2 * n
        reached, total = reached.unionByName(frontier), total + most
    # Ids that are no node (an edge may name a record of another space) end here.
    kept = likely(nodes, ["id"], reached, total).join(light(reached, total), "id", "left_semi")
    if request.node_types:
        kept = kept.where(F.col("type").isin(*request.node_types))
    kept = cut(kept)
    few = light(kept.select("id"), total)
    touched = touched.distinct()
    for end in ("from_id", "to_id"):
        touched = touched.join(few.withColumnRenamed("id", end), end, "left_semi")
    edges = touched.select("id", "type", "from_id", "to_id").orderBy("id")
    kept = kept.orderBy("id")
    return (kept.limit(request.max_nodes) if request.max_nodes > 0 else kept), edges
