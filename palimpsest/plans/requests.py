"""Requests: what to read, as plain values. An empty tuple or None means that a filter is off."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import datetime, timezone

from palimpsest.errors import INPUT_INVALID, RecordError
from palimpsest.plans.schema import DEFAULT_SPACE


# What a command takes where its request names no bound.
SEARCH_LIMIT, LOOKUP_LIMIT, TIMELINE_LIMIT, NEIGHBORHOOD_NODES, CONTEXT_BLOCKS, CONTEXT_TEXT = 10, 25, 25, 50, 16, 512


def space_of(space_id: str | None) -> str:
    return (space_id or "").strip() or DEFAULT_SPACE


@dataclass(frozen=True)
class Scope:
    group_ids: tuple[str, ...] = ()
    source_ids: tuple[str, ...] = ()
    source_kinds: tuple[str, ...] = ()
    entity_types: tuple[str, ...] = ()
    fact_status: tuple[str, ...] = ()

    @property
    def by_episode(self) -> bool:
        return bool(self.group_ids or self.source_ids or self.source_kinds)


@dataclass(frozen=True)
class Temporal:
    """Knowledge time (as_of), observation range (both ends count), validity (half-open)."""

    as_of: datetime | None = None
    observed_from: datetime | None = None
    observed_to: datetime | None = None
    valid_at: datetime | None = None
    valid_from: datetime | None = None
    valid_to: datetime | None = None
    include_inactive: bool = False

    @property
    def is_set(self) -> bool:
        return self != Temporal()

    @classmethod
    def parse(cls, **given: str | bool | None) -> Temporal:
        """From RFC 3339 strings, with the combinations that make no sense refused."""
        out = {}
        for name, value in given.items():
            if isinstance(value, str):
                try:
                    at = datetime.fromisoformat(value.replace("Z", "+00:00"))
                except ValueError:
                    raise RecordError(INPUT_INVALID, f"{name} is no RFC 3339 time", value=value) from None
                if at.tzinfo is None:
                    raise RecordError(INPUT_INVALID, f"{name} has no time zone", value=value)
                value = at.astimezone(timezone.utc)
            out[name] = value
        made = cls(**{k: v for k, v in out.items() if v is not None})
        if made.valid_at and (made.valid_from or made.valid_to):
            raise RecordError(INPUT_INVALID, "valid_at excludes valid_from and valid_to")
        for low, high in (("valid_from", "valid_to"), ("observed_from", "observed_to")):
            a, b = getattr(made, low), getattr(made, high)
            if a and b and not (a < b or low == "observed_from" and a == b):
                raise RecordError(INPUT_INVALID, f"{low} must come before {high}")
        return made


@dataclass(frozen=True)
class Page:
    limit: int = 0
    cursor: str = ""

    @property
    def offset(self) -> int:
        if not self.cursor:
            return 0
        head, _, tail = self.cursor.partition(":")
        if head != "offset" or not tail.isdigit():
            raise RecordError(INPUT_INVALID, "cursor is not of the form offset:N", cursor=self.cursor)
        return int(tail)


@dataclass(frozen=True)
class Include:
    provenance: bool = False
    supporting_episodes: bool = False
    related_entities: bool = False
    supporting_facts: bool = False
    snippets: bool = False

    @property
    def for_search(self) -> bool:
        return self.provenance or self.supporting_episodes or self.related_entities or self.snippets

    @property
    def for_lookup(self) -> bool:
        return self.provenance or self.supporting_episodes or self.related_entities


@dataclass(frozen=True)
class SearchRequest:
    query_text: str
    space_id: str = ""
    types: tuple[str, ...] = ()
    mode: str = "hybrid"
    anchor_ids: tuple[str, ...] = ()
    predicates: tuple[str, ...] = ()
    min_score: float | None = None
    scope: Scope = field(default_factory=Scope)
    temporal: Temporal = field(default_factory=Temporal)
    include: Include = field(default_factory=Include)
    page: Page = field(default_factory=Page)

    @property
    def kinds(self) -> tuple[str, ...]:
        return self.types or ("fact", "episode", "entity")


@dataclass(frozen=True)
class LookupRequest:
    space_id: str = ""
    subject_ids: tuple[str, ...] = ()
    predicates: tuple[str, ...] = ()
    object_ids: tuple[str, ...] = ()
    object_text: str = ""
    scope: Scope = field(default_factory=Scope)
    temporal: Temporal = field(default_factory=Temporal)
    include: Include = field(default_factory=Include)
    page: Page = field(default_factory=Page)


@dataclass(frozen=True)
class TimelineRequest:
    space_id: str = ""
    anchor_ids: tuple[str, ...] = ()
    event_types: tuple[str, ...] = ()
    descending: bool = False
    scope: Scope = field(default_factory=Scope)
    temporal: Temporal = field(default_factory=Temporal)
    page: Page = field(default_factory=Page)


@dataclass(frozen=True)
class NeighborhoodRequest:
    anchor_ids: tuple[str, ...]
    space_id: str = ""
    max_hops: int = 1
    max_nodes: int = 0
    edge_types: tuple[str, ...] = ()
    node_types: tuple[str, ...] = ()
    scope: Scope = field(default_factory=Scope)
    temporal: Temporal = field(default_factory=Temporal)


@dataclass(frozen=True)
class ProvenanceRequest:
    kind: str
    id: str
    space_id: str = ""
    max_depth: int = 8
    temporal: Temporal = field(default_factory=Temporal)


def with_inactive(temporal: Temporal) -> Temporal:
    return replace(temporal, include_inactive=True)
