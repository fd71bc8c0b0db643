"""Whole answers: a page, the cursor of the next one, and the records that come along if the request asks for them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from palimpsest.memory import Memory
from palimpsest.operators.lookup import fact_order, matching_facts
from palimpsest.operators.paging import next_cursor, ordered_page
from palimpsest.operators.search import HIT, Included, all_hits, hit_order, included, lookup_included, named_hits
from palimpsest.operators.timeline import events, time_order
from palimpsest.plans.requests import LookupRequest, SearchRequest, TimelineRequest
from palimpsest.sources.shared import cut


@dataclass(frozen=True)
class Response:
    rows: DataFrame
    next_cursor: str = ""
    included: Included | None = None


def search_response(memory: Memory, request: SearchRequest) -> Response:
    """A page of hits. The included records belong to all hits, not only to the page."""
    hits = cut(all_hits(memory, request))
    page = named_hits(ordered_page(hits, hit_order(), request.page))
    more = included(memory, request, hits) if request.include.for_search else None
    return Response(page, next_cursor(hits.select(HIT[0]), request.page), more)


def lookup_response(memory: Memory, request: LookupRequest) -> Response:
    """A page of facts; the included records belong to all facts that fit."""
    facts = cut(matching_facts(memory, request))
    more = lookup_included(memory, request, facts) if request.include.for_lookup else None
    return Response(ordered_page(facts, fact_order(), request.page), next_cursor(facts.select("id"), request.page), more)


def timeline_response(memory: Memory, request: TimelineRequest) -> Response:
    found = cut(events(memory, request))
    return Response(ordered_page(found, time_order(request), request.page), next_cursor(found.select("event_id"), request.page))
