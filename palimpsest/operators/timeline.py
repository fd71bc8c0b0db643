"""Events of episodes and facts over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import summary, text_or_empty
from palimpsest.memory import Memory
from palimpsest.operators.paging import ordered_page
from palimpsest.operators.scope import anchored, episodes_for, fact_anchored, facts_for
from palimpsest.operators.temporal import at, observed_within
from palimpsest.plans import schema
from palimpsest.plans.requests import TimelineRequest, with_inactive


def events(memory: Memory, request: TimelineRequest) -> DataFrame:
    """(event_id, event_type, record_type, record_id, timestamp, summary) of all that fits, unordered.

    A fact's events follow its status at the time asked for: one that was superseded and later
    retracted has the later event only.
    """
    t = with_inactive(request.temporal)
    wanted = lambda kind: not request.event_types or kind in request.event_types
    parts = []
    if wanted("episode"):
        own = episodes_for(memory, request.space_id, request.scope, t).where(anchored(request.anchor_ids, F.col("id"), F.col("source_id")))
        parts.append(
            own.select(
                F.concat(F.lit("evt:"), "id").alias("event_id"), F.lit("episode").alias("event_type"), F.lit("episode").alias("record_type"), F.col("id").alias("record_id"),
                F.coalesce("observed_at", "ingested_at").alias("timestamp"), summary(F.col("content")).alias("summary"),
            )
        )
    kinds = [k for k in ("fact_created", "fact_superseded", "fact_retracted") if wanted(k)]
    if kinds:
        facts = facts_for(memory, request.space_id, request.scope, t).where(fact_anchored(request.anchor_ids))
        made = {
            "fact_created": (F.lit(True), "created", F.coalesce("observed_at", "created_at"), F.col("predicate")),
            "fact_superseded": (F.col("status") == schema.SUPERSEDED, "superseded", F.col("updated_at"), F.col("predicate")),
            "fact_retracted": (F.col("status") == schema.RETRACTED, "retracted", F.coalesce("retracted_at", "updated_at"), text_or_empty("retraction_reason")),
        }
        one = lambda k: F.struct(made[k][0].alias("on"), F.concat(F.lit("evt:"), "id", F.lit(f":{made[k][1]}")).alias("event_id"), F.lit(k).alias("event_type"), made[k][2].alias("timestamp"), made[k][3].alias("summary"))
        # One pass over the facts: each makes up to two of the three.
        each = facts.select(F.col("id").alias("record_id"), F.explode(F.array(*map(one, kinds))).alias("e")).where("e.on")
        parts.append(each.select("e.event_id", "e.event_type", F.lit("fact").alias("record_type"), "record_id", "e.timestamp", "e.summary"))
    if not parts:
        return memory.spark.createDataFrame([], "event_id string, event_type string, record_type string, record_id string, timestamp timestamp, summary string")
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    out = out.where(observed_within(F.col("timestamp"), t))
    return out.where(F.col("timestamp") <= at(t.as_of)) if t.as_of else out


def time_order(request: TimelineRequest) -> list[Column]:
    time = F.col("timestamp")
    return [time.desc() if request.descending else time.asc(), F.col("event_id").asc()]


def timeline(memory: Memory, request: TimelineRequest) -> DataFrame:
    """One page of events in time order (or its reverse); equal times by event id."""
    return ordered_page(events(memory, request), time_order(request), request.page)
