"""Bounded context from a search: blocks of hits, facts, episodes and entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.functions.text import clipped
from palimpsest.memory import Memory
from palimpsest.operators.paging import ordered_page
from palimpsest.operators.search import Included, all_hits, hit_order, included
from palimpsest.plans.requests import SearchRequest


def context_blocks(hits: DataFrame, more: Included, *, max_blocks: int = 16, max_text: int = 512) -> DataFrame:
    """(position, kind, title, text, record_id, truncated): hits in order, then the records that come along by id.

    Each part is cut to the bound before parts meet, so at most four times the bound is ordered.
    """
    most = max_blocks if max_blocks > 0 else 16

    def part(df: DataFrame, rank: int, kind: str, title, text: str, key: str, order) -> DataFrame:
        few = df.orderBy(*order).limit(most + 1)
        place = F.row_number().over(Window.orderBy(*order))
        return few.select(F.lit(rank).alias("r"), place.alias("n"), F.lit(kind).alias("kind"), title.alias("title"), clipped(F.col(text), max_text).alias("text"), F.col(key).alias("record_id"))

    named = lambda column: F.concat(column, F.lit(":"), "id")
    by_id = [F.col("id")]
    rows = (
        part(hits, 0, "hit", F.concat("hit_type", F.lit(":"), "record_id"), "matched_text", "record_id", hit_order())
        .unionByName(part(more.facts, 1, "supporting_fact", named("predicate"), "value_text", "id", by_id))
        .unionByName(part(more.episodes, 2, "supporting_episode", named("kind"), "content", "id", by_id))
        .unionByName(part(more.entities, 3, "related_entity", named("type"), "canonical_name", "id", by_id))
    )
    whole = Window.orderBy("r", "n")
    rows = rows.withColumn("position", F.row_number().over(whole)).withColumn("truncated", F.count("*").over(Window.partitionBy(F.lit(1))) > most)
    return rows.where(F.col("position") <= most).select("position", "kind", "title", "text", "record_id", "truncated").orderBy("position")


def search_context(memory: Memory, request: SearchRequest, *, max_blocks: int = 16, max_text: int = 512) -> DataFrame:
    """A search's page and its included records as blocks."""
    hits = all_hits(memory, request)
    return context_blocks(ordered_page(hits, hit_order(), request.page), included(memory, request, hits), max_blocks=max_blocks, max_text=max_text)
