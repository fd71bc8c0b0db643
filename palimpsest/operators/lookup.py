"""Point reads and fact lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.errors import ENTITY_NOT_FOUND, FACT_NOT_FOUND, QUERY_FAILED, SOURCE_NOT_FOUND, RecordError
from palimpsest.memory import Memory
from palimpsest.operators.paging import ordered_page
from palimpsest.operators.scope import facts_for
from palimpsest.operators.temporal import entity_versions, fact_versions, of_ids, visible_episodes, visible_sources
from palimpsest.plans.requests import LookupRequest, Temporal, space_of

_MISSING = {"entity": ENTITY_NOT_FOUND, "fact": FACT_NOT_FOUND, "source": SOURCE_NOT_FOUND, "episode": QUERY_FAILED}


def record(memory: Memory, kind: str, record_id: str, space_id: str = "", temporal: Temporal | None = None) -> DataFrame:
    """At most one row: the record's version at the time asked for. A fact without any temporal filter has any status."""
    t = temporal or Temporal()
    own, memory = F.col("space_id") == space_of(space_id), of_ids(memory, record_id)
    readers = {
        "episode": lambda: visible_episodes(memory, t),
        "source": lambda: visible_sources(memory, t),
        "entity": lambda: entity_versions(memory, t, own),
        "fact": lambda: fact_versions(memory, t, own) if t.is_set else memory.facts,
    }
    if kind not in readers:
        raise RecordError(QUERY_FAILED, "unsupported record kind", kind=kind)
    return readers[kind]().where((F.col("id") == record_id) & own)


def get_record(memory: Memory, kind: str, record_id: str, space_id: str = "", temporal: Temporal | None = None):
    """The row itself; raises where it does not exist, lies in another space or is not visible."""
    found = record(memory, kind, record_id, space_id, temporal).head(1)
    if found:
        return found[0]
    own = {"episode": memory.episodes, "source": memory.sources, "entity": memory.entities, "fact": memory.facts}[kind]
    held = own.where(F.col("id") == record_id).select("space_id").head(1)
    if not held:
        raise RecordError(_MISSING[kind], f"{kind} not found", id=record_id)
    if held[0][0] != space_of(space_id):
        raise RecordError(QUERY_FAILED, "record not found in space", id=record_id, space_id=space_of(space_id))
    raise RecordError(QUERY_FAILED, "record not visible at requested time", id=record_id)


def matching_facts(memory: Memory, request: LookupRequest) -> DataFrame:
    """All facts that fit, unordered."""
    only = F.lit(True)
    for column, wanted in (("subject_id", request.subject_ids), ("predicate", request.predicates), ("object_id", request.object_ids)):
        if wanted:
            only = only & F.col(column).isin(*wanted)
    facts = facts_for(memory, request.space_id, request.scope, request.temporal, only)
    if request.object_text:
        facts = facts.where(F.contains(F.lower("value_text"), F.lit(request.object_text.lower())))
    return facts


def fact_order() -> list[Column]:
    return [F.col("observed_at").desc_nulls_last(), F.col("id").asc()]


def lookup_facts(memory: Memory, request: LookupRequest) -> DataFrame:
    """One page of facts: last observed first, then by id."""
    return ordered_page(matching_facts(memory, request), fact_order(), request.page)
