"""Schemas of the six tables of a memory, and of the search projection."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _TS = T.StringType(), T.DoubleType(), T.TimestampType()
_LIST = T.ArrayType(_S)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


SOURCES = _struct(id=_S, space_id=_S, kind=_S, uri=_S, external_ref=_S, created_at=_TS, metadata_json=_S)
EPISODES = _struct(id=_S, space_id=_S, kind=_S, content=_S, source_id=_S, group_id=_S, observed_at=_TS, ingested_at=_TS, metadata_json=_S)
ENTITIES = _struct(
    id=_S, space_id=_S, namespace=_S, type=_S, canonical_name=_S, aliases=_LIST, stable_key=_S, duplicate_of=_S, created_at=_TS, updated_at=_TS, metadata_json=_S
)
FACTS = _struct(
    id=_S, space_id=_S, predicate=_S, subject_id=_S, object_id=_S, value_text=_S, confidence=_D, status=_S, valid_from=_TS, valid_to=_TS, observed_at=_TS,
    created_at=_TS, updated_at=_TS, retracted_at=_TS, retraction_reason=_S, supporting_episode_ids=_LIST, superseded_by=_S, supersedes=_LIST,
    supersede_reason=_S, metadata_json=_S,
)


def _revisions(of: T.StructType, key: str) -> T.StructType:
    first = _struct(**{"id": _S, key: _S, "revision_kind": _S, "tx_time": _TS})
    return T.StructType([*first.fields, *(f for f in of.fields if f.name != "id")])


FACT_REVISIONS = _revisions(FACTS, "fact_id")
ENTITY_REVISIONS = _revisions(ENTITIES, "entity_id")
PROJECTION = T.StructType(
    [T.StructField("projection_id", _S), T.StructField("search_text", _S), T.StructField("metadata", T.MapType(_S, _S)), T.StructField("observed_at_ms", T.LongType())]
)

TABLES = {
    "sources": SOURCES,
    "episodes": EPISODES,
    "entities": ENTITIES,
    "facts": FACTS,
    "fact_revisions": FACT_REVISIONS,
    "entity_revisions": ENTITY_REVISIONS,
}

# Fixed values of a fact's life.
ACTIVE, SUPERSEDED, RETRACTED = "active", "superseded", "retracted"
STATUSES = (ACTIVE, SUPERSEDED, RETRACTED)
DEFAULT_SPACE = "default"
