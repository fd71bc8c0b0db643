"""Commands over a store: `python -m palimpsest COMMAND ...`. Results go to the output as JSON.

The exit status is 0, that of the error's code, or 2 for a wrong command line.
"""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict, is_dataclass
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest import benches
from palimpsest.errors import INPUT_INVALID, QUERY_FAILED, RecordError
from palimpsest.functions.text import entity_id
from palimpsest.memory import Memory
from palimpsest.operators import admin, context, graph, index, lifecycle, lookup, policy, provenance, responses
from palimpsest.plans.requests import CONTEXT_BLOCKS, CONTEXT_TEXT, LOOKUP_LIMIT, NEIGHBORHOOD_NODES, SEARCH_LIMIT, TIMELINE_LIMIT, Include, LookupRequest, NeighborhoodRequest, Page, ProvenanceRequest, Scope, SearchRequest, Temporal, TimelineRequest
from palimpsest.sources import documents
from palimpsest.sources.store import Store

_TIMES = ("as_of", "valid_at", "observed_from", "observed_to", "valid_from", "valid_to")


def _names(text: str | None) -> tuple[str, ...]:
    return tuple(x.strip() for x in (text or "").split(",") if x.strip())


def _plain(value):
    """Rows, times and data classes as JSON values."""
    if isinstance(value, DataFrame):
        return [_plain(r.asDict(recursive=True)) for r in value.toLocalIterator()]
    if is_dataclass(value) and not isinstance(value, type):
        return {k: _plain(getattr(value, k)) for k in value.__dataclass_fields__}
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items() if v is not None}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return value


def _moment(text: str | None) -> datetime | None:
    return Temporal.parse(as_of=text).as_of if text else None


def _parser() -> argparse.ArgumentParser:
    root = argparse.ArgumentParser(prog="palimpsest", description="Temporal graph memory on Spark.")
    root.add_argument("--confirm", action="store_true", help="allow what replaces or changes many records")
    top = root.add_subparsers(dest="command", required=True)

    def command(under, name: str, run, *options: str, db: bool = True):
        """Options are written `name`, `name!` (required), `name?` (a switch) or `name=default` (a number)."""
        p = under.add_parser(name)
        if db:
            p.add_argument("--db", required=True, help="the store's folder")
        for o in options:
            if o.endswith("?"):
                p.add_argument(f"--{o[:-1]}", action="store_true")
            elif "=" in o:
                key, value = o.split("=")
                p.add_argument(f"--{key}", type=int, default=int(value))
            else:
                p.add_argument(f"--{o.rstrip('!')}", required=o.endswith("!"))
        p.set_defaults(run=run)

    def group(name: str):
        return top.add_parser(name).add_subparsers(dest="part", required=True)

    scope = ("group-id", "source-id", "source-kind", "entity-type", "fact-status")
    times = tuple(t.replace("_", "-") for t in _TIMES)
    anchors = ("entity", "fact", "episode", "source")
    command(top, "init", _init, "force?")
    command(top, "migrate", lambda s, a: {"facts": s.migrate().fact_revisions.count()})
    ingest = group("ingest")
    for name, text in (("episode", ("content", "content-file")), ("file", ("file!",))):
        command(ingest, name, _ingest_episode, "id", "kind!", *text, "space", "group-id", "source-id", "source-kind", "source-uri", "source-external-ref", "observed-at", "policy-path")
    for name in ("json", "batch"):
        command(ingest, name, _ingest_json, "file!")
    command(top, "get", lambda s, a: _get(s, a, a.kind), "kind!", "id!", "space", *times, "include-inactive?")
    command(top, "search", _search, "query!", "type", "mode", "space", "entity", "predicate", *scope, *times, "include-inactive?", "min-score", "cursor", "policy-path", "recipe", f"limit={SEARCH_LIMIT}", "include-related?", "index")
    command(top, "context", _context, "query!", "type", "space", "entity", f"limit={SEARCH_LIMIT}", f"max-blocks={CONTEXT_BLOCKS}", f"max-text={CONTEXT_TEXT}")
    command(top, "timeline", _timeline, *anchors, "event-type", "space", *times, "descending?", "cursor", f"limit={TIMELINE_LIMIT}")
    command(top, "provenance", _provenance, "kind", "id", *anchors[:3], "space", *times, "include-inactive?", "max-depth=8")
    command(top, "neighborhood", _neighborhood, *anchors, "space", *times, "hops=1", f"max-nodes={NEIGHBORHOOD_NODES}")
    inspect = group("inspect")
    command(inspect, "schema", lambda s, a: admin.inspect_schema(s.load()))
    command(inspect, "counts", lambda s, a: {r["kind"]: r["n"] for r in admin.inspect_counts(s.load()).collect()})
    for kind in ("episode", "entity", "fact", "source"):
        command(inspect, kind, lambda s, a, k=kind: _get(s, a, k), "id!", "space")
    entity = group("entity")
    command(entity, "get", lambda s, a: _get(s, a, "entity"), "id!", "space")
    command(entity, "merge-preview", lambda s, a: admin.entity_duplicates(s.load()))
    command(entity, "merge", _merge, "target!", "sources!", "reason")
    fact = group("fact")
    command(fact, "get", lambda s, a: _get(s, a, "fact"), "id!", "space")
    command(fact, "lookup", _lookup, "subject-id", "predicate", "object-id", "object-text", "space", *scope, *times, "include-inactive?", "cursor", f"limit={LOOKUP_LIMIT}", "include-related?")
    ends = tuple(f"{end}-{x}" for end in ("subject", "object") for x in ("namespace", "type", "name", "stable-key"))
    written = ("predicate!", "subject-id", "object-id", "value-text", "confidence", "space", "observed-at", "valid-from", "valid-to", "cardinality", "supporting-episodes!")
    command(fact, "assert", _assert, "id", *written, "upsert-subject?", "upsert-object?", *ends)
    command(fact, "supersede", _supersede, "id!", *written, "reason!")
    command(fact, "retract", _retract, "id!", "reason!")
    packs = group("policy")
    command(packs, "validate", lambda s, a: dict(zip(("issues", "warnings"), policy.validate(policy.load_pack(a.path)), strict=True)), "path!", db=False)
    command(packs, "show", lambda s, a: asdict(policy.load_pack(a.path)), "path!", db=False)
    command(packs, "list-recipes", lambda s, a: policy.load_pack(a.path).recipes, "path!", db=False)
    of_index = group("index")
    for name in ("build", "rebuild"):
        command(of_index, name, lambda s, a: index.write_projections(s.load(), a.root, store_version=s.version()), "root!")
    command(of_index, "status", lambda s, a: {**index.index_status(s.spark, a.root), "fresh": index.index_fresh(s.spark, a.root, s.version())}, "root!")
    command(of_index, "verify", lambda s, a: index.verify_index(s.load(), a.root), "root!")
    manage = group("admin")
    command(manage, "checkpoint", lambda s, a: {"version": s.checkpoint()})
    command(manage, "compact", _compact, "apply?")
    command(manage, "export", lambda s, a: documents.write_export(s.load(), a.out, importable=a.importable) or {"out": a.out}, "out!", "importable?")
    command(manage, "import", _import, "in!")
    bench = group("bench")
    command(bench, "ingest", lambda s, a: benches.bench_ingest(s, a.episodes, a.facts_per_episode), "episodes=0", "facts-per-episode=1")
    command(bench, "query", lambda s, a: benches.bench_query(s, a.query, entity=a.entity or "", fact=a.fact or "", iterations=a.iterations), "query!", "entity", "fact", "iterations=10")
    command(bench, "lifecycle", lambda s, a: benches.bench_lifecycle(s, a.iterations), "iterations=0")
    return root


def _temporal(a) -> Temporal:
    given = {t: getattr(a, t, None) for t in _TIMES}
    return Temporal.parse(**given, include_inactive=getattr(a, "include_inactive", False))


def _scope(a) -> Scope:
    return Scope(_names(a.group_id), _names(a.source_id), _names(a.source_kind), _names(a.entity_type), _names(a.fact_status))


def _one(*values: str | None) -> tuple[str, ...]:
    """The anchors that are given: one at most."""
    found = tuple(v for v in values if v)
    if len(found) > 1:
        raise RecordError(INPUT_INVALID, "give one anchor only")
    return found


def _confirmed(a) -> None:
    if not a.confirm:
        raise RecordError(INPUT_INVALID, "this changes many records: give --confirm before the command")


def _batch(spark: SparkSession, **values) -> DataFrame:
    """One row of a batch; what is not given is null."""
    kinds = {"supporting_episode_ids": "array<string>", "aliases": "array<string>", "confidence": "double"}
    times = ("observed_at", "valid_from", "valid_to")
    ddl = ", ".join(f"{k} {kinds.get(k) or ('timestamp' if k in times else 'string')}" for k in values)
    return spark.createDataFrame([tuple(values.values())], ddl).withColumn("pos", F.lit(0))


def _init(store: Store, a) -> dict:
    held = store.version()
    if held and a.force:
        _confirmed(a)
    if held is None or a.force:
        store.save(Memory.empty(store.spark), base=held, whole=True)
    return {"db": a.db, "version": store.version()}


def _ingest_episode(store: Store, a) -> dict:
    path = getattr(a, "file", None) or getattr(a, "content_file", None)
    text = getattr(a, "content", None)
    if path:
        with open(path, encoding="utf-8") as f:
            text = f.read()
    if a.policy_path and text is not None:
        found = policy.drop_tokens(policy.load_pack(a.policy_path))
        if any(t in text.lower() for t in found):
            return {"dropped": True}
    batch = _batch(store.spark, id=a.id, space_id=a.space, kind=a.kind, content=text, group_id=a.group_id, source_id=a.source_id, source_kind=a.source_kind, source_uri=a.source_uri or path, source_external_ref=a.source_external_ref, observed_at=_moment(a.observed_at))
    before = store.load().episodes.select("id")
    after = store.commit(lifecycle.ingest_episodes, batch, _now())
    new = after.episodes.join(before, "id", "left_anti").head(1)
    return {"id": new[0]["id"] if new else a.id}


def _now() -> datetime:
    return datetime.now(timezone.utc)


def _ingest_json(store: Store, a) -> dict:
    after = store.commit(lifecycle.ingest_batch, _now(), **documents.read_batch(store.spark, a.file))
    return {r["kind"]: r["n"] for r in admin.inspect_counts(after).collect()}


def _import(store: Store, a) -> dict:
    _confirmed(a)
    store.commit(lifecycle.ingest_batch, _now(), **documents.read_batch(store.spark, getattr(a, "in")))
    return {"in": getattr(a, "in"), "version": store.version()}


def _get(store: Store, a, kind: str) -> dict:
    temporal = _temporal(a)
    return lookup.get_record(store.load(), kind, a.id, a.space or "", temporal if temporal.is_set else None).asDict(recursive=True)


def _search(store: Store, a):
    request = SearchRequest(
        a.query, a.space or "", _names(a.type), a.mode or "hybrid", _names(a.entity), _names(a.predicate), float(a.min_score) if a.min_score else None, _scope(a), _temporal(a),
        Include(provenance=a.include_related, supporting_episodes=a.include_related, related_entities=a.include_related), Page(a.limit, a.cursor or ""),
    )
    if a.recipe:
        if not a.policy_path:
            raise RecordError(INPUT_INVALID, "a recipe needs --policy-path")
        request = policy.apply_recipe(policy.load_pack(a.policy_path), a.recipe, request, _now())
    m = store.load()
    if not a.index:
        return responses.search_response(m, request)
    if not index.index_fresh(store.spark, a.index, store.version()):
        index.write_projections(m, a.index, store_version=store.version())
    own = index.postings(index.read_projections(store.spark, a.index))
    return index.index_response(m, request, lambda n: index.index_candidates(own, index.query_tokens(a.query), n))


def _context(store: Store, a):
    request = SearchRequest(a.query, a.space or "", _names(a.type), anchor_ids=_names(a.entity), page=Page(a.limit))
    return context.search_context(store.load(), request, max_blocks=a.max_blocks, max_text=a.max_text)


def _timeline(store: Store, a):
    request = TimelineRequest(a.space or "", _one(a.entity, a.fact, a.episode, a.source), _names(a.event_type), a.descending, temporal=_temporal(a), page=Page(a.limit, a.cursor or ""))
    return responses.timeline_response(store.load(), request)


def _graph(parts: tuple[DataFrame, DataFrame]) -> dict:
    return {"nodes": parts[0], "edges": parts[1]}


def _provenance(store: Store, a) -> dict:
    kinds = {k: getattr(a, k) for k in ("entity", "fact", "episode") if getattr(a, k)}
    if a.kind and a.id:
        kinds[a.kind] = a.id
    if len(kinds) != 1:
        raise RecordError(INPUT_INVALID, "give --kind and --id, or one of --entity, --fact and --episode")
    kind, record = next(iter(kinds.items()))
    m, t = store.load(), _temporal(a)
    if kind in ("entity", "fact", "episode"):
        lookup.get_record(m, kind, record, a.space or "", t if t.is_set else None)  # an error says why there is none
    return _graph(provenance.provenance(m, ProvenanceRequest(kind, record, a.space or "", a.max_depth, t)))


def _neighborhood(store: Store, a) -> dict:
    return _graph(graph.neighborhood(store.load(), NeighborhoodRequest(_one(a.entity, a.fact, a.episode, a.source), a.space or "", a.hops, a.max_nodes, temporal=_temporal(a))))


def _merge(store: Store, a) -> dict:
    _confirmed(a)
    sources = _names(a.sources)
    if a.target in sources:
        raise RecordError(INPUT_INVALID, "an entity cannot be merged into itself", target=a.target)
    for record in (a.target, *sources):
        lookup.get_record(store.load(), "entity", record)
    pairs = store.spark.createDataFrame([(a.target, s) for s in sources], "target_id string, source_id string")
    store.commit(admin.merge_entities, pairs, _now(), confirm=True)
    return {"target": a.target, "merged": list(sources)}


def _lookup(store: Store, a):
    request = LookupRequest(a.space or "", _names(a.subject_id), _names(a.predicate), _names(a.object_id), a.object_text or "", _scope(a), _temporal(a), Include(supporting_episodes=a.include_related), Page(a.limit, a.cursor or ""))
    return responses.lookup_response(store.load(), request)


def _fact_row(store: Store, a, **more) -> DataFrame:
    given = dict(space_id=a.space, predicate=a.predicate, subject_id=a.subject_id, object_id=a.object_id, value_text=a.value_text, confidence=float(a.confidence) if a.confidence else None, observed_at=_moment(a.observed_at),
                 valid_from=_moment(a.valid_from), valid_to=_moment(a.valid_to), cardinality=a.cardinality, supporting_episode_ids=list(_names(a.supporting_episodes)))
    return _batch(store.spark, **(given | more))


def _assert(store: Store, a) -> dict:
    """A fact, with its ends made where they are to be upserted: entities and fact are one write."""
    spark, ends = store.spark, {}
    rows = []
    for end in ("subject", "object"):
        if getattr(a, f"upsert_{end}"):
            namespace, kind, name, key = (getattr(a, f"{end}_{x}") for x in ("namespace", "type", "name", "stable_key"))
            made = spark.range(1).select(entity_id(F.lit(namespace or ""), F.lit(kind or ""), F.lit(key or name or ""))).first()[0]
            ends[f"{end}_id"] = getattr(a, f"{end}_id") or made
            rows.append(_batch(spark, id=ends[f"{end}_id"], space_id=a.space, namespace=namespace, type=kind, canonical_name=name, stable_key=key))
    entities = None if not rows else rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1].withColumn("pos", F.lit(1)))
    facts = _fact_row(store, a, id=a.id, **ends)
    before = store.load().facts.select("id")
    after = store.commit(lifecycle.ingest_batch, _now(), entities=entities, facts=_observed(store, facts))
    return after.facts.join(before, "id", "left_anti").first().asDict(recursive=True)


def _observed(store: Store, facts: DataFrame) -> DataFrame:
    """Without a time of its own, a fact is observed when its first supporting episode was, else now."""
    named = facts.withColumn("_id", F.col("id")).withColumn("id", F.lit("x"))
    found = lifecycle.inferred_observed_at(store.load(), named, _now())
    return found.withColumn("id", F.col("_id")).drop("_id", "observed_at_basis", "observed_at_supporting_episode_id")


def _supersede(store: Store, a) -> dict:
    before = store.load().facts.select("id")
    after = store.commit(lifecycle.supersede_facts, _fact_row(store, a, id=None, old_id=a.id), a.reason, _now())
    return {"old_id": a.id, "new_id": after.facts.join(before, "id", "left_anti").first()["id"]}


def _retract(store: Store, a) -> dict:
    after = store.commit(lifecycle.retract_facts, _batch(store.spark, id=a.id), a.reason, _now())
    return after.facts.where(F.col("id") == a.id).first().asDict(recursive=True)


def _compact(store: Store, a) -> dict:
    base, m = store.version(), store.load()
    entities, facts, after = admin.compact(m, _now(), apply=a.apply, confirm=a.confirm)
    out = {"entities": _plain(entities), "facts": _plain(facts), "applied": a.apply}
    if a.apply:
        store.save(after, base=base)
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=None) -> int:
    """Run one command. Without a session one is made, with Spark's own settings."""
    argv = list(sys.argv[1:] if argv is None else argv)
    if "--confirm" in argv:  # anywhere on the line
        argv = ["--confirm", *(x for x in argv if x != "--confirm")]
    out = out or sys.stdout
    try:
        a = _parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    session = spark or SparkSession.builder.appName("palimpsest").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        store = Store(session, a.db) if getattr(a, "db", None) else None
        json.dump(_plain(a.run(store, a)), out, ensure_ascii=False)
        out.write("\n")
        return 0
    except RecordError as e:
        json.dump({"error": {"code": e.code, "message": e.message, "details": _plain(e.details)}}, out)
        out.write("\n")
        return e.exit_status
    except OSError as e:
        json.dump({"error": {"code": QUERY_FAILED, "message": str(e), "details": {}}}, out)
        out.write("\n")
        return RecordError(QUERY_FAILED, str(e)).exit_status
    finally:
        if spark is None:
            session.stop()
