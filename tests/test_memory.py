"""The reads and writes on literal memories: lifecycles, time, scopes, search, graph, stores."""

import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from palimpsest.errors import RecordError
from palimpsest.functions import text
from palimpsest.memory import Memory
from palimpsest.functions.stats import percentile_of, percentiles
from palimpsest.operators import admin, context, graph, index, lifecycle, lookup, paging, policy, provenance, responses, search, timeline
from palimpsest.plans.requests import Include, LookupRequest, NeighborhoodRequest, Page, ProvenanceRequest, Scope, SearchRequest, Temporal, TimelineRequest
from palimpsest.sources import documents
from palimpsest.sources.store import Store, changes


def day(text_: str) -> datetime:
    return datetime.fromisoformat(text_).replace(tzinfo=timezone.utc)


T0 = day("2026-01-01")
FACT = "id string, predicate string, subject_id string, object_id string, value_text string, valid_from timestamp, valid_to timestamp, supporting_episode_ids array<string>, cardinality string, pos int"


def facts(spark, *rows):
    """(id, subject, predicate, object, value, from, to, cardinality)"""
    made = [(i, p, s, o, v, f, t, ["ep-1"], c, n) for n, (i, s, p, o, v, f, t, c) in enumerate(rows)]
    return spark.createDataFrame(made, FACT)


@pytest.fixture(scope="module")
def base(spark):
    eps = spark.createDataFrame([("ep-1", "note", "first note about GraphAwareNeedle", "s1", T0, 0), ("ep-2", "note", "second", "s2", None, 1)], "id string, kind string, content string, source_id string, observed_at timestamp, pos int")
    m = lifecycle.ingest_episodes(Memory.empty(spark), eps.withColumn("source_kind", F.lit("chat")), T0)
    ents = spark.createDataFrame([("a", "Project", "GraphAwareNeedle", 0), ("b", "Team", "Team Blue", 1)], "id string, type string, canonical_name string, pos int")
    return lifecycle.upsert_entities(m.settled(), ents, T0).settled()


def status(m):
    return {r["id"]: r["status"] for r in m.facts.collect()}


def test_cardinality_one_supersedes_what_overlaps(spark, base):
    one = lambda i, f, t=None: (i, "a", "OWNER", None, i, f, t, "one")
    m = lifecycle.assert_facts(base, facts(spark, one("f1", day("2026-01-01")), one("f2", day("2026-02-01"))), T0).settled()
    rows = {r["id"]: r for r in m.facts.collect()}
    assert rows["f1"]["status"] == "superseded" and rows["f1"]["superseded_by"] == "f2" and rows["f1"]["valid_to"] == datetime(2026, 2, 1)
    assert rows["f2"]["supersedes"] == ["f1"] and rows["f2"]["supersede_reason"] == lifecycle.SLOT_REASON
    # A backfill before everything leaves both alone; a correction of the past takes what it overlaps.
    back = lifecycle.assert_facts(m, facts(spark, one("f0", day("2025-01-01"), day("2025-06-01"))), T0 + timedelta(days=1))
    assert status(back) == {"f0": "active", "f1": "superseded", "f2": "active"}
    many = lifecycle.assert_facts(base, facts(spark, ("g1", "a", "OWNER", None, "x", None, None, "many"), ("g2", "a", "OWNER", None, "y", None, None, None), one("g3", None)), T0)
    assert status(many) == {"g1": "superseded", "g2": "superseded", "g3": "active"}
    assert sorted(r["revision_kind"] for r in many.fact_revisions.collect()) == ["assert"] * 3 + ["auto_supersede"] * 2


def test_writes_are_checked(spark, base):
    good = ("f1", "a", "P", None, "x", None, None, None)
    for row, message in (
        (("f1", "nobody", "P", None, "x", None, None, None), "entity not found"),
        (("f1", "a", " ", None, "x", None, None, None), "required"),
        (("f1", "a", "P", "nobody", "x", None, None, None), "entity not found"),
        (("f1", "a", "P", None, "x", day("2026-02-01"), day("2026-01-01"), None), "interval"),
        (("f1", "a", "P", None, "x", None, None, "few"), "cardinality"),
    ):
        with pytest.raises(RecordError, match=message):
            lifecycle.assert_facts(base, facts(spark, row), T0)
    with pytest.raises(RecordError, match="already exists"):
        lifecycle.assert_facts(base, facts(spark, good, good), T0)
    with pytest.raises(RecordError, match="lifecycle-managed"):
        lifecycle.assert_facts(base, facts(spark, good).withColumn("metadata_json", F.lit('{"superseded_by": "x"}')), T0)
    with pytest.raises(RecordError, match="lifecycle-managed"):
        lifecycle.assert_facts(base, facts(spark, good).withColumn("status", F.lit("retracted")), T0)
    with pytest.raises(RecordError, match="supporting episode"):
        lifecycle.assert_facts(base, facts(spark, good).withColumn("supporting_episode_ids", F.array(F.lit("none"))), T0)
    with pytest.raises(RecordError, match="different content"):
        lifecycle.ingest_episodes(base, base.episodes.withColumns({"content": F.lit("other"), "pos": F.lit(0)}), T0)
    again = lifecycle.ingest_episodes(base, base.episodes.withColumn("pos", F.lit(0)), T0)
    assert again.episodes.count() == 2 and again.sources.count() == 2
    with pytest.raises(RecordError, match="another space"):
        lifecycle.ingest_episodes(base, spark.createDataFrame([("x", "s1", "n", "c", 0)], "space_id string, source_id string, kind string, content string, pos int"), T0)


def test_supersede_retract_and_history(spark, base):
    m = lifecycle.assert_facts(base, facts(spark, ("f1", "a", "P", None, "old", day("2026-01-01"), None, None)), day("2026-02-01")).settled()
    batch = facts(spark, ("f2", "a", "P", None, "new", day("2026-03-01"), None, None)).withColumn("old_id", F.lit("f1"))
    m = lifecycle.supersede_facts(m, batch, "fixed", day("2026-03-01")).settled()
    m = lifecycle.retract_facts(m, spark.createDataFrame([("f2", 0)], "id string, pos int"), "wrong", day("2026-04-01")).settled()
    assert status(m) == {"f1": "superseded", "f2": "retracted"}
    seen = lambda at, **k: sorted(r["id"] for r in lookup.lookup_facts(m, LookupRequest(temporal=Temporal(as_of=day(at), **k))).collect())
    assert [seen(d) for d in ("2026-01-15", "2026-02-15", "2026-03-15", "2026-04-15")] == [[], ["f1"], ["f2"], []]
    assert seen("2026-04-15", include_inactive=True) == ["f1", "f2"]
    same = lifecycle.retract_facts(m, spark.createDataFrame([("f2", 0)], "id string, pos int"), "again", day("2026-05-01"))
    assert same.facts.where("id = 'f2'").first()["retraction_reason"] == "wrong"
    for bad, message in (("f2", "retracted"), ("f1", "superseded"), ("none", "not found")):
        with pytest.raises(RecordError, match=message):
            lifecycle.supersede_facts(m, batch.withColumns({"old_id": F.lit(bad), "id": F.lit("f9")}), "r", day("2026-05-01"))
    with pytest.raises(RecordError, match="subject and predicate"):
        lifecycle.supersede_facts(lifecycle.assert_facts(base, facts(spark, ("f1", "a", "P", None, "x", None, None, None)), T0), batch.withColumn("predicate", F.lit("Q")), "r", T0)
    nodes, edges = provenance.provenance(m, ProvenanceRequest("fact", "f2", temporal=Temporal(include_inactive=True)))
    assert {r["id"] for r in nodes.collect()} == {"f1", "f2", "ep-1", "s1"} and {r["type"] for r in edges.collect()} == {"ASSERTS", "FROM_SOURCE", "SUPERSEDES"}
    events = [r["event_id"] for r in timeline.timeline(m, TimelineRequest(anchor_ids=("a",))).collect()]
    assert events == ["evt:f1:created", "evt:f1:superseded", "evt:f2:created", "evt:f2:retracted"] or set(events) == {"evt:f1:created", "evt:f1:superseded", "evt:f2:created", "evt:f2:retracted"}


def test_knowledge_and_domain_time_differ(spark, base):
    late = facts(spark, ("f", "a", "P", None, "x", day("2026-01-01"), day("2026-03-01"), None))
    m = lifecycle.assert_facts(base, late, day("2026-06-01"))
    seen = lambda **k: lookup.lookup_facts(m, LookupRequest(temporal=Temporal(**k))).count()
    assert (seen(as_of=day("2026-05-01")), seen(valid_at=day("2026-02-01")), seen(valid_at=day("2026-03-01")), seen(valid_at=day("2026-04-01"))) == (0, 1, 0, 0)


def test_entities_merge_and_keep_identity(spark, base):
    batch = spark.createDataFrame([("a", "Project", "Needle 2", ["n", " "], '{"k": {"x": [1]}, "z": 1}', 0), ("a", "Project", "Needle 3", ["n", "m"], '{"z": "two"}', 1)], "id string, type string, canonical_name string, aliases array<string>, metadata_json string, pos int")
    m = lifecycle.upsert_entities(base, batch, day("2026-02-01"))
    row = m.entities.where("id = 'a'").first()
    assert row["canonical_name"] == "Needle 3" and row["aliases"] == ["n", "m"] and json.loads(row["metadata_json"]) == {"k": {"x": [1]}, "z": "two"}
    assert m.entity_revisions.where("entity_id = 'a'").count() == 3
    for column, value in (("type", "Other"), ("space_id", "elsewhere")):
        with pytest.raises(RecordError):
            lifecycle.upsert_entities(m, batch.withColumn(column, F.lit(value)), T0)
    made = lifecycle.upsert_entities(Memory.empty(spark), spark.createDataFrame([("My Team/One", "Team", "NS", 0)], "canonical_name string, type string, namespace string, pos int"), T0)
    assert made.entities.first()["id"] == "ns:team:my-team-one"


def test_batches_are_all_or_nothing(spark, base):
    eps = spark.createDataFrame([("n", "c", 0)], "kind string, content string, pos int")
    with pytest.raises(RecordError):
        lifecycle.ingest_batch(base, T0, episodes=eps, facts=facts(spark, ("f", "nobody", "P", None, "x", None, None, None)))
    out = lifecycle.ingest_batch(base, T0, episodes=eps, facts=facts(spark, (None, "a", "P", None, "x", None, None, None)))
    assert out.facts.first()["id"] == "fact_000001" and out.episodes.count() == 3
    with pytest.raises(RecordError, match="revisions"):
        lifecycle.ingest_batch(base, T0, fact_revisions=lifecycle.assert_facts(base, facts(spark, ("f", "a", "P", None, "x", None, None, None)), T0).fact_revisions)


def test_search_scores(spark, base):
    rows = [("needle",), ("observability signal",), ("alpha alpha",), ("x",)]
    df = spark.createDataFrame(rows, "text string")
    values = [round(r[0], 6) for r in df.select(text.sparse_score(text.terms(F.col("text")), ["alpha"], {})).collect()]
    assert values == [0, 0, 0.540541, 0]
    assert round(text.idf(10, 1), 4) == round(0.813237 * 2.45, 4)
    found = spark.createDataFrame([("episode", "e", "observability signal", "", [])], "hit_type string, record_id string, text string, matched_text string, keys array<string>")
    (row,) = search.scored(found, "observabilty", "hybrid").collect()
    assert (round(row["base"], 6), row["reason"]) == (0.4587, "hybrid_vector_similarity")
    assert [r["g"] for r in spark.createDataFrame([("a😀bcd",)], "t string").select(F.explode(text.trigrams(F.col("t"))).alias("g")).collect()] == ["a😀b", "😀bc", "bcd"]


def test_search_expands_by_two_hops(spark, base):
    m = lifecycle.assert_facts(base, facts(spark, ("f1", "a", "HAS_OWNER", "b", None, None, None, None), ("f2", "b", "HAS_CHANNEL", None, "room", None, None, None)), T0)
    m = m.with_tables(facts=m.facts.withColumn("supporting_episode_ids", F.when(F.col("id") == "f2", F.array(F.lit("ep-2"))).otherwise(F.col("supporting_episode_ids"))))
    hits = {r["record_id"]: r for r in search.search(m, SearchRequest("GraphAwareNeedle", types=("fact", "entity"))).collect()}
    assert hits["f1"]["reasons"] == ["graph_expansion"] and hits["f2"]["reasons"] == ["graph_expansion_bfs"]
    assert (round(hits["f1"]["score"], 4), round(hits["f2"]["score"], 4)) == (0.45, 0.2025)
    assert {r["record_id"] for r in search.search(m, SearchRequest("GraphAwareNeedle", types=("fact", "entity"), mode="keyword")).collect()} == {"a"}
    blocks = context.search_context(m, SearchRequest("GraphAwareNeedle", types=("fact", "entity")), max_blocks=4).collect()
    assert [b["kind"] for b in blocks] == ["hit", "hit", "hit", "supporting_fact"] and blocks[0]["truncated"]
    nodes, edges = graph.neighborhood(m, NeighborhoodRequest(("a",), max_hops=2))
    assert {r["id"] for r in nodes.collect()} == {"a", "f1", "b", "ep-1"} and edges.count() == 3
    with pytest.raises(RecordError):
        graph.neighborhood(m, NeighborhoodRequest(()))
    with pytest.raises(RecordError):
        search.search(m, SearchRequest("  "))


def test_scope_and_pages(spark, base):
    m = lifecycle.assert_facts(base, facts(spark, *((f"f{i}", "a", "P", None, str(i), None, None, None) for i in range(5))), T0)
    assert lookup.lookup_facts(m, LookupRequest(scope=Scope(source_ids=("s2",)))).count() == 0
    assert lookup.lookup_facts(m, LookupRequest(scope=Scope(source_ids=("s1",), entity_types=("Project",)))).count() == 5
    own = lookup.matching_facts(m, LookupRequest())
    pages, page = [], Page(limit=2)
    while True:
        pages.append([r["id"] for r in lookup.lookup_facts(m, LookupRequest(page=page)).collect()])
        cursor = paging.next_cursor(own, page)
        if not cursor:
            break
        page = Page(2, cursor)
    assert pages == [["f0", "f1"], ["f2", "f3"], ["f4"]]
    with pytest.raises(RecordError):
        Page(1, "key:1").offset
    with pytest.raises(RecordError):
        Temporal.parse(valid_at="2026-01-01T00:00:00Z", valid_from="2026-01-01T00:00:00Z")
    with pytest.raises(RecordError, match="not visible"):
        lookup.get_record(m, "entity", "a", temporal=Temporal(as_of=T0 - timedelta(days=1)))
    with pytest.raises(RecordError, match="not found in space"):
        lookup.get_record(m, "entity", "a", "elsewhere")


def test_duplicates_and_compaction(spark, base):
    ents = spark.createDataFrame([("p1", "Project", "Same Name", 0), ("p2", "Project", " same name", 1)], "id string, type string, canonical_name string, pos int")
    m = lifecycle.assert_facts(lifecycle.upsert_entities(base, ents, T0), facts(spark, ("c1", "a", "P", None, "x", None, None, None), ("c2", "a", "P", None, "X ", None, None, None)), T0)
    groups, doubles, after = admin.compact(m, T0 + timedelta(days=1), apply=True, confirm=True)
    assert [(r["target_id"], r["source_ids"]) for r in groups.collect()] == [("p1", ["p2"])]
    assert [(r["target_id"], r["source_ids"]) for r in doubles.collect()] == [("c1", ["c2"])]
    assert after.entities.where("id = 'p2'").first()["duplicate_of"] == "p1" and after.facts.where("id = 'c2'").first()["retraction_reason"] == "duplicate_of:c1"
    with pytest.raises(RecordError, match="confirmed"):
        admin.compact(m, T0, apply=True)


def test_store_versions(spark, base, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    store.save(base)
    first = store.version()
    after = store.commit(lifecycle.assert_facts, facts(spark, ("f1", "a", "P", None, "x", None, None, None)), T0)
    assert after.facts.count() == 1 and store.version() > first
    with pytest.raises(RecordError):
        store.commit(lifecycle.assert_facts, facts(spark, ("f1", "a", "P", None, "x", None, None, None)), T0)
    assert Store(spark, str(tmp_path / "db")).load().facts.count() == 1
    with pytest.raises(RecordError, match="reading only"):
        Store(spark, str(tmp_path / "db"), read_only=True).save(base)
    seeded = store.migrate()
    assert store.migrate().fact_revisions.count() == seeded.fact_revisions.count()
    assert changes(base.facts, after.facts).collect()[0]["change"] == "created"


def test_json_batches_and_projections(spark, base, tmp_path):
    doc = {"episodes": [{"id": "e1", "kind": "note", "content": "hi", "source": {"kind": "chat", "external_ref": "r 1"}}], "entities": [{"type": "Team", "canonical_name": "T", "id": "t"}],
           "facts": [{"id": "f", "predicate": "P", "subject_id": "t", "value_text": "v", "supporting_episode_ids": ["e1"]}]}
    path = tmp_path / "batch.json"
    path.write_text(json.dumps(doc))
    m = documents.ingest_json(Memory.empty(spark), str(path), T0)
    assert m.facts.first()["id"] == "f" and m.episodes.first()["source_id"] == "src:default:chat:r-1"
    for bad in ({**doc, "odd": 1}, {**doc, "facts": [{**doc["facts"][0], "odd": 1}]}, {**doc, "fact_revisions": [{}]}):
        path.write_text(json.dumps(bad))
        with pytest.raises(RecordError):
            documents.read_batch(spark, str(path))
    index.write_projections(m, str(tmp_path / "p"))
    stored = index.read_projections(spark, str(tmp_path / "p"))
    assert index.projection_differences(stored, m).count() == 0 and stored.count() == 3
    assert index.projection_differences(stored.where("projection_id <> 'fact:f'"), m).first()["state"] == "missing"


def test_policy_packs(tmp_path):
    (tmp_path / "SKILL.md").write_text("text")
    (tmp_path / "ontology.yaml").write_text("version: 1\nentity_types: [Team]\npredicates: [P]\n")
    (tmp_path / "episode_rules.yaml").write_text("version: 1\ndrop:\n  - name: small\n    when:\n      contains_any: [ok]\n")
    (tmp_path / "search_recipes.yaml").write_text("version: 1\nrecipes:\n  r: {strategy: neighborhood, filters: {window_days: 3}, expand: {entity_types: [Team]}}\n")
    pack = policy.load_pack(str(tmp_path))
    assert policy.validate(pack) == ([], []) and policy.drop_tokens(pack) == ["ok"]
    made = policy.apply_recipe(pack, "r", SearchRequest("q"), T0)
    assert made.temporal.observed_from == T0 - timedelta(days=3) and made.scope.entity_types == ("Team",) and made.include.provenance
    assert len(policy.validate(policy.Pack())[0]) == 4


def test_supersede_refuses_a_fact_named_twice(spark, base):
    m = lifecycle.assert_facts(base, facts(spark, ("f1", "a", "P", None, "old", None, None, None)), T0).settled()
    twice = facts(spark, ("n1", "a", "P", None, "x", None, None, None), ("n2", "a", "P", None, "y", None, None, None)).withColumn("old_id", F.lit("f1"))
    with pytest.raises(RecordError, match="names this superseded fact already"):
        lifecycle.supersede_facts(m, twice, "r", T0)
    chain = facts(spark, ("n1", "a", "P", None, "x", None, None, None), ("n2", "a", "P", None, "y", None, None, None)).withColumn("old_id", F.when(F.col("id") == "n1", "f1").otherwise("n1"))
    with pytest.raises(RecordError, match="fact not found"):
        lifecycle.supersede_facts(m, chain, "r", T0)


def test_slots_by_force(spark, base):
    import random

    random.seed(5)
    rows = []
    for i in range(120):
        start = random.choice([None, day("2026-01-01") + timedelta(days=random.randrange(60))])
        end = None if random.random() < 0.4 else (start or day("2026-01-01")) + timedelta(days=1 + random.randrange(30))
        rows.append((f"f{i:03d}", random.choice("ab"), "OWNER", None, str(i), start, end, random.choice(["one", "many"])))
    got = {r["old_id"]: r["new_id"] for r in lifecycle.slot_replacements(base.facts, facts(spark, *rows).withColumns({"space_id": F.lit("default"), "created_at": F.lit(T0)})).collect()}
    apart = lambda x, y: (x[6] is not None and y[5] is not None and x[6] <= y[5]) or (x[5] is not None and y[6] is not None and x[5] >= y[6])
    want = {}
    for n, x in enumerate(rows):
        later = next((y for y in rows[n + 1 :] if y[1] == x[1] and y[7] == "one" and not apart(x, y)), None)
        if later:
            want[x[0]] = later[0]
    assert len(want) > 50 and got == want


def test_store_commits_by_space_and_refuses_lost_updates(spark, base, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    store.save(base)
    first, began = store.log(), store.version()
    other = spark.createDataFrame([("z", "Team", "Z", "elsewhere", 0)], "id string, type string, canonical_name string, space_id string, pos int")
    store.commit(lifecycle.upsert_entities, other, T0)
    after = store.log()
    assert after["episodes"] == first["episodes"] and after["entities"]["default"] == first["entities"]["default"] and "elsewhere" in after["entities"]
    assert store.load(began).entities.count() == 2 and store.load().entities.count() == 3
    with pytest.raises(RecordError, match="committed first"):
        store.save(base, base=began)
    assert store.load().entities.count() == 3
    store.checkpoint()
    assert store.load().entities.count() == 3 and store.log()["episodes"]["default"]["version"] != first["episodes"]["default"]["version"]
    assert not [f for f in (tmp_path / "db" / "_log").iterdir() if f.name.startswith(".v") and f.name.endswith(".json")]


def test_store_in_memory(spark, base):
    store = Store(spark, in_memory=True)
    store.save(base)
    assert store.commit(lifecycle.assert_facts, facts(spark, ("f1", "a", "P", None, "x", None, None, None)), T0).facts.count() == 1
    with pytest.raises(RecordError):
        Store(spark)
    with pytest.raises(RecordError):
        Store(spark, "x", in_memory=True)


def test_numbers_follow_the_order(spark):
    from palimpsest.sources.shared import with_numbers

    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(5)
    rows = with_numbers(df, ["k"], "n").collect()
    assert all(r["k"] == r["n"] for r in rows) and len(rows) == 1000
    assert with_numbers(df.limit(0), ["k"], "n").count() == 0


def test_export_is_imported_again(spark, base, tmp_path):
    m = lifecycle.assert_facts(base, facts(spark, ("f1", "a", "P", None, "x", day("2026-01-01"), None, None), ("f2", "b", "P", "a", None, None, None, None)), T0)
    m = lifecycle.retract_facts(m.settled(), spark.createDataFrame([("f2", 0)], "id string, pos int"), "gone", T0)
    documents.write_export(m, str(tmp_path / "out"), importable=True)
    back = documents.ingest_json(Memory.empty(spark), str(tmp_path / "out"), T0)
    row = back.facts.collect()
    assert [(r["id"], r["value_text"], r["valid_from"], r["supporting_episode_ids"]) for r in row] == [("f1", "x", datetime(2026, 1, 1), ["ep-1"])]
    assert {(r["id"], r["kind"]) for r in back.sources.collect()} == {(r["id"], r["kind"]) for r in base.sources.collect()}
    assert {(r["id"], r["content"], r["observed_at"]) for r in back.episodes.collect()} == {(r["id"], r["content"], r["observed_at"]) for r in base.episodes.collect()}
    documents.write_export(m, str(tmp_path / "all"))
    with pytest.raises(RecordError, match="revisions"):
        documents.ingest_json(Memory.empty(spark), str(tmp_path / "all"), T0)


def test_json_lines_and_text_files(spark, tmp_path):
    lines = [{"episodes": [{"id": f"e{i}", "kind": "note", "content": f"text {i}"}]} for i in range(5)]
    (tmp_path / "many.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n")
    m = documents.ingest_json(Memory.empty(spark), str(tmp_path / "many.jsonl"), T0)
    assert sorted(r["id"] for r in m.episodes.collect()) == [f"e{i}" for i in range(5)]
    (tmp_path / "texts").mkdir()
    for name in "ab":
        (tmp_path / "texts" / name).write_text(f"content {name}")
    m = lifecycle.ingest_episodes(Memory.empty(spark), documents.text_episodes(spark, str(tmp_path / "texts"), kind="file"), T0)
    assert [(r["id"], r["content"]) for r in m.episodes.orderBy("id").collect()] == [("ep_000001", "content a"), ("ep_000002", "content b")]


def test_index_manifest_status_and_freshness(spark, base, tmp_path):
    store, root = Store(spark, str(tmp_path / "db")), str(tmp_path / "index")
    store.save(base)
    assert not index.index_fresh(spark, root, store.version())
    made = index.write_projections(store.load(), root, store_version=store.version())
    assert index.index_status(spark, root)["projection_count"] == 4 == made["projection_count"] and index.verify_index(store.load(), root)["valid"]
    assert index.index_fresh(spark, root, store.version()) and made["counts"] == {"episodes": 2, "entities": 2, "facts": 0, "fact_revisions": 0, "entity_revisions": 2}
    again = index.projection_hash(index.projections(store.load()).repartition(3)).first()[0]
    assert again == made["projection_hash"] and len(again) == 64
    after = store.commit(lifecycle.assert_facts, facts(spark, ("f1", "a", "P", None, "x", None, None, None)), T0)
    assert not index.index_fresh(spark, root, store.version())
    with pytest.raises(RecordError, match="counts"):
        index.verify_index(after, root)
    for name in ("../x", "", ".."):
        (tmp_path / "index" / ".index.json.crc").unlink(missing_ok=True)
        (tmp_path / "index" / "index.json").write_text(json.dumps({**made, "projection_file": name}))
        with pytest.raises(RecordError, match="plain folder"):
            index.read_projections(spark, root)


def test_index_answers(spark, base):
    assert index.parse_candidates('[{"doc_id": " fact:a "}, {"doc_id": ""}, {"doc_id": "fact:a"}, {"doc_id": "episode:b"}]') == ["fact:a", "episode:b"]
    assert index.parse_candidates('["x", "x", " y"]') == ["x", "y"]
    for bad in ("{}", "no", "[1]"):
        with pytest.raises(RecordError):
            index.parse_candidates(bad)
    rows = [(f"f{i:02d}", "a", "P", None, "needle", None, None, None) for i in range(12)]
    m = lifecycle.assert_facts(base, facts(spark, *rows), T0).settled()
    ids = [f"fact:f{i:02d}" for i in range(12)]
    fetch = lambda n: index.candidate_rows(spark, ids[:n])
    seen, page = [], Page(limit=5)
    while True:
        got = index.index_response(m, SearchRequest("needle", mode="keyword", page=page, include=Include(snippets=True)), fetch)
        seen += [r["record_id"] for r in got.rows.collect()]
        assert {r["id"] for r in got.included.facts.collect()} <= set(seen)
        if not got.next_cursor:
            break
        page = Page(5, got.next_cursor)
    assert seen == [f"f{i:02d}" for i in range(12)]
    filtered = SearchRequest("needle", mode="keyword", types=("fact",), page=Page(limit=5))
    many = lambda n: index.candidate_rows(spark, [f"fact:none{i}" for i in range(n)])
    assert index.index_response(m, filtered, many).rows.count() == 5  # all records instead
    with pytest.raises(RecordError, match="cursor_invalid"):
        index.index_response(m, SearchRequest("needle", mode="keyword", types=("fact",), page=Page(5, "key:1:fact:f00")), many)


def test_responses_include_what_is_asked_for(spark, base):
    m = lifecycle.assert_facts(base, facts(spark, *((f"f{i}", "a", "P", "b", "needle", None, None, None) for i in range(3))), T0).settled()
    plain = responses.search_response(m, SearchRequest("needle", types=("fact",), mode="keyword", page=Page(limit=2)))
    assert plain.included is None and plain.next_cursor == "offset:2" and plain.rows.count() == 2
    more = responses.search_response(m, SearchRequest("needle", types=("fact",), mode="keyword", page=Page(2, "offset:2"), include=Include(related_entities=True)))
    assert more.next_cursor == "" and {r["id"] for r in more.included.entities.collect()} == {"a", "b"} and more.included.facts.count() == 3
    found = responses.lookup_response(m, LookupRequest(page=Page(limit=1), include=Include(supporting_episodes=True)))
    assert found.next_cursor == "offset:1" and {r["id"] for r in found.included.episodes.collect()} == {"ep-1"} and {r["id"] for r in found.included.sources.collect()} == {"s1"}
    assert responses.lookup_response(m, LookupRequest(include=Include(snippets=True))).included is None
    assert responses.timeline_response(m, TimelineRequest(page=Page(limit=2))).next_cursor == "offset:2"


def test_percentiles(spark):
    df = spark.createDataFrame([(float(x),) for x in range(100)] + [(None,)], "x double")
    assert [tuple(r) for r in percentiles(df, "x").orderBy("percentile").collect()] == [(0.5, 49.0), (0.95, 94.0), (0.99, 98.0)]
    assert percentiles(df.limit(0), "x").count() == 0 and percentile_of([3.0, 1.0, 2.0], 0.5) == 2.0 and percentile_of([], 0.5) == 0.0
