"""Measurements of a store: ingest, reads and lifecycle writes. A write is one batch, so a bench measures batches, not single records."""

from __future__ import annotations

import time
from datetime import datetime, timezone

from pyspark.sql import functions as F

from palimpsest.errors import INPUT_INVALID, RecordError
from palimpsest.functions.stats import percentile_of
from palimpsest.operators import graph, lifecycle, provenance, search, timeline
from palimpsest.plans.requests import SEARCH_LIMIT, TIMELINE_LIMIT, NeighborhoodRequest, Page, ProvenanceRequest, SearchRequest, TimelineRequest
from palimpsest.sources.store import Store


def _now() -> datetime:
    return datetime.now(timezone.utc)


def synthetic(spark, episodes: int, facts_per_episode: int, tag: str):
    """(episodes, entities, facts) batches: one source and entity an episode, and so many facts."""
    own = spark.range(episodes).withColumn("id", F.col("id").cast("long"))
    name = lambda kind: F.concat(F.lit(f"{kind}:{tag}:"), F.col("id"))
    eps = own.select(name("ep").alias("id"), F.lit("bench").alias("kind"), F.concat(F.lit("synthetic episode "), "id").alias("content"), F.lit("bench").alias("source_kind"), F.concat(F.lit(f"{tag}-"), "id").alias("source_external_ref"), F.col("id").alias("pos"))
    entities = own.select(name("entity").alias("id"), F.lit("BenchEntity").alias("type"), F.concat(F.lit("Bench Entity "), "id").alias("canonical_name"), F.col("id").alias("pos"))
    each = own.select("id", F.explode(F.sequence(F.lit(0), F.lit(facts_per_episode - 1))).alias("k"))
    facts = each.select(F.concat(name("fact"), F.lit(":"), "k").alias("id"), F.lit("BENCH_FACT").alias("predicate"), name("entity").alias("subject_id"), F.concat(F.lit("value "), F.pmod(F.xxhash64("id", "k"), F.lit(1000))).alias("value_text"),
                        F.array(name("ep")).alias("supporting_episode_ids"), (F.col("id") * facts_per_episode + F.col("k")).alias("pos"))
    return eps, entities, facts


def bench_ingest(store: Store, episodes: int, facts_per_episode: int = 1) -> dict:
    if episodes <= 0 or facts_per_episode <= 0:
        raise RecordError(INPUT_INVALID, "episodes and facts per episode must be positive")
    eps, entities, facts = synthetic(store.spark, episodes, facts_per_episode, f"b{time.time_ns():x}")
    start = time.perf_counter()
    store.commit(lifecycle.ingest_batch, _now(), episodes=eps, entities=entities, facts=facts)
    took = time.perf_counter() - start
    n = episodes * facts_per_episode
    return {"episodes": episodes, "facts": n, "seconds": took, "episodes_per_second": episodes / took, "facts_per_second": n / took}


def bench_query(store: Store, query: str, *, entity: str = "", fact: str = "", iterations: int = 10) -> dict:
    """Milliseconds at p50, p95 and p99 of a search and, around the given records, of a neighbourhood, a timeline and a provenance."""
    if iterations <= 0 or not query.strip():
        raise RecordError(INPUT_INVALID, "iterations must be positive and the query not blank")
    m = store.load()
    runs = {"search": lambda: search.search(m, SearchRequest(query, page=Page(SEARCH_LIMIT))).collect()}
    if entity:
        runs["neighborhood"] = lambda: graph.neighborhood(m, NeighborhoodRequest((entity,), max_hops=2, max_nodes=100))[0].collect()
    if anchor := entity or fact:
        runs["timeline"] = lambda: timeline.timeline(m, TimelineRequest(anchor_ids=(anchor,), page=Page(TIMELINE_LIMIT))).collect()
    if fact:
        runs["provenance"] = lambda: provenance.provenance(m, ProvenanceRequest("fact", fact, max_depth=2))[0].collect()
    out = {"iterations": iterations}
    for name, run in runs.items():
        took = []
        for _ in range(iterations):
            start = time.perf_counter()
            run()
            took.append((time.perf_counter() - start) * 1000)
        out[name] = {f"p{round(100 * p)}_ms": percentile_of(took, p) for p in (0.5, 0.95, 0.99)}
    return out


def bench_lifecycle(store: Store, iterations: int) -> dict:
    """So many facts asserted, superseded and retracted, each step as one batch."""
    if iterations <= 0:
        raise RecordError(INPUT_INVALID, "iterations must be positive")
    tag = f"l{time.time_ns():x}"
    eps, entities, facts = synthetic(store.spark, iterations, 1, tag)
    store.commit(lifecycle.ingest_batch, _now(), episodes=eps, entities=entities, facts=facts)
    start = time.perf_counter()
    newer = facts.withColumns({"old_id": F.col("id"), "id": F.concat("id", F.lit(":new")), "value_text": F.lit("replaced")})
    store.commit(lifecycle.supersede_facts, newer, "bench", _now())
    store.commit(lifecycle.retract_facts, newer.select("id", "pos"), "bench", _now())
    took = time.perf_counter() - start
    return {"supersedes": iterations, "retracts": iterations, "seconds": took, "operations_per_second": 2 * iterations / took}
