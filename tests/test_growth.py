"""What queries move and hold: shuffled bytes and rows of tasks stay small where results do not need them."""

import os
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.stats import percentiles
from palimpsest.memory import LazyMemory, Memory
from palimpsest.operators import graph, index, lifecycle, lookup, provenance, search
from palimpsest.plans import schema
from palimpsest.plans.requests import NeighborhoodRequest, ProvenanceRequest, SearchRequest, Temporal
from palimpsest.queries import QUERIES
from palimpsest.sources import derive, shared
from palimpsest.sources.store import WRITERS, Store, digests

SF = "/root/testdata/sf0.001"
MOMENT = datetime(2026, 2, 1, tzinfo=timezone.utc)


def rows(spark, like, n, **columns):
    """`n` records of a schema from SQL expressions over `k`; those not named are null."""
    own = spark.range(n).withColumnRenamed("id", "k")
    return own.select(*(F.expr(columns.get(f.name, "NULL")).cast(f.dataType).alias(f.name) for f in like.fields))


def shuffled(spark, run) -> int:
    """Bytes written to shuffles by what `run` starts."""

    def total() -> int:
        spark._jsc.sc().listenerBus().waitUntilEmpty()
        found = spark._jsc.sc().statusStore().executorList(False).iterator()
        out = 0
        while found.hasNext():
            out += found.next().totalShuffleWrite()
        return out

    before = total()
    run()
    return total() - before


LONG = "concat_ws(' ', transform(sequence(1, 60), i -> sha2(concat(k, ' ', i), 256)))"


@pytest.fixture(scope="module")
def wide(spark):
    """Facts with long texts, each with two revisions; one was changed."""
    own = {"space_id": "'default'", "predicate": "'P'", "subject_id": "concat('s', k)", "value_text": LONG, "status": "'active'", "created_at": "timestamp'2026-01-01 00:00:00'", "updated_at": "timestamp'2026-01-01 00:00:00'"}
    facts = rows(spark, schema.FACTS, 500, id="concat('f', k)", **own)
    rev = {"fact_id": "concat('f', k)", "revision_kind": "'assert'", "tx_time": "timestamp'2026-01-01 00:00:00'"}
    revisions = rows(spark, schema.FACT_REVISIONS, 500, id="concat('r1', k)", **own | rev | {"value_text": f"CASE WHEN k = 7 THEN 'old' ELSE {LONG} END"}).unionByName(rows(spark, schema.FACT_REVISIONS, 500, id="concat('r2', k)", **own | rev))
    return Memory.empty(spark).with_tables(facts=facts, fact_revisions=revisions).settled()


def test_projections_move_texts_of_changed_records_only(spark, wide):
    docs = index.projections(wide)
    assert docs.where("search_text LIKE '% old'").select("projection_id").collect() == [("fact:f7",)]
    assert shuffled(spark, lambda: index.projections(wide).write.format("noop").mode("overwrite").save()) < 200_000


def test_projection_differences_move_no_texts(spark, wide):
    docs = index.projections(wide)
    blank = F.when(F.col("projection_id") == "fact:f1", "").when(F.col("projection_id") == "fact:f2", None).otherwise(F.col("search_text"))
    stored = docs.where("projection_id <> 'fact:f3'").withColumn("search_text", blank).unionByName(docs.where("projection_id = 'fact:f3'").withColumn("projection_id", F.lit("fact:x")))
    found = []
    assert shuffled(spark, lambda: found.extend(index.projection_differences(stored, wide, docs).collect())) < 200_000
    assert sorted(map(tuple, found)) == [("fact:f1", "changed"), ("fact:f2", "changed"), ("fact:f3", "missing"), ("fact:x", "stale")]
    nulls = docs.where("projection_id = 'fact:f1'").withColumn("search_text", F.lit(None).cast("string"))
    empty = nulls.withColumn("search_text", F.lit(""))
    assert index.projection_differences(nulls, wide, empty).collect() == [("fact:f1", "changed")]


def test_matching_documents_make_no_postings(spark, wide):
    docs = index.projections(wide).where("projection_id <> 'fact:f9'").unionByName(spark.createDataFrame([("fact:f9", "P s9  S8:s9", None, None)], schema.PROJECTION))
    query = ["s9", "s8", "p", "zzz", "0"]
    found = []
    assert shuffled(spark, lambda: found.extend(index.matching_documents(docs, query, 30).collect())) < 100_000
    assert found == index.index_candidates(index.postings(docs), query, 30).collect() and found[0][0] == "fact:f9" and len(found) == 30


def test_reading_one_record_moves_no_other(spark, wide):
    past = Temporal(as_of=MOMENT, include_inactive=True)
    found = []
    assert shuffled(spark, lambda: found.extend(lookup.record(wide, "fact", "f7", temporal=past).collect())) < 20_000
    assert [(r["id"], len(r["value_text"])) for r in found] == [("f7", 60 * 65 - 1)]
    assert lookup.record(wide, "fact", "f7", "elsewhere", past).isEmpty() and lookup.record(wide, "fact", "none", temporal=past).isEmpty()


def test_provenance_aggregates_the_records_it_shows_only(spark, wide):
    linked = F.when(F.col("id") == "f2", F.lit("f3")).otherwise(F.col("superseded_by"))
    m = wide.with_tables(facts=wide.facts.withColumn("superseded_by", linked), fact_revisions=wide.fact_revisions.withColumn("superseded_by", F.when(F.col("fact_id") == "f2", F.lit("f3")).otherwise(F.col("superseded_by"))))
    past, seen = Temporal(as_of=MOMENT, include_inactive=True), {}

    def run():
        for k in ("f2", "f3"):
            seen[k] = sorted(r["id"] for r in provenance.provenance(m, ProvenanceRequest("fact", k, temporal=past))[0].collect())

    assert shuffled(spark, run) < 60_000
    assert seen == {"f2": ["f2", "f3"], "f3": ["f2", "f3"]}


def test_percentiles_count_equal_values_once(spark):
    df = spark.range(200_000).select((F.xxhash64("id") % 5).alias("x"))
    ordered, found = sorted(r["x"] for r in df.collect()), []
    assert shuffled(spark, lambda: found.extend(percentiles(df, "x").orderBy("percentile").collect())) < 20_000
    assert [tuple(r) for r in found] == [(p, ordered[int(p * 199_999)]) for p in (0.5, 0.95, 0.99)]


def test_neighborhood_of_many_moves_edges_at_the_frontier_only(spark, monkeypatch):
    own = {"space_id": "'default'", "predicate": "'IN'", "subject_id": "concat('s', k)", "object_id": "if(k < 40, 'hub', concat('o', k))", "status": "'active'", "supporting_episode_ids": "array(concat('e', k))"}
    facts = rows(spark, schema.FACTS, 20_000, id="concat('f', k)", **own)
    entities = rows(spark, schema.ENTITIES, 20_000, id="concat('s', k)", space_id="'default'", canonical_name="'n'").unionByName(rows(spark, schema.ENTITIES, 1, id="'hub'", space_id="'default'", canonical_name="'hub'"))
    m = Memory.empty(spark).with_tables(facts=facts, entities=entities, episodes=rows(spark, schema.EPISODES, 20_000, id="concat('e', k)", space_id="'default'", kind="'order'", source_id="'s'"), sources=rows(spark, schema.SOURCES, 1, id="'s'", space_id="'default'", kind="'orders'")).settled()
    request, found = NeighborhoodRequest(("hub",), max_hops=2), {}

    def run(key):
        nodes, edges = graph.neighborhood(m, request)
        found[key] = (sorted(map(tuple, nodes.collect())), sorted(map(tuple, edges.collect())))

    run("sent")
    monkeypatch.setattr(shared, "LIGHT", 5)
    assert shuffled(spark, lambda: run("narrowed")) < 400_000
    monkeypatch.setattr(shared, "HASHED", 5)
    run("shuffled")
    assert found["sent"] == found["narrowed"] == found["shuffled"] and len(found["sent"][0]) == 121


def noop(df):
    df.write.format("noop").mode("overwrite").save()


def test_superseding_joins_the_facts_once(spark, wide):
    m = wide.with_tables(entities=rows(spark, schema.ENTITIES, 500, id="concat('s', k)", space_id="'default'"), episodes=rows(spark, schema.EPISODES, 1, id="'e'", space_id="'default'")).settled()
    batch = spark.range(3).selectExpr("concat('n', id) AS id", "concat('f', id) AS old_id", "'P' AS predicate", "concat('s', id) AS subject_id", "'x' AS value_text", "array('e') AS supporting_episode_ids", "CAST(id AS int) AS pos")
    out = []
    once = shuffled(spark, lambda: noop(m.facts.repartition(4, "id")))
    assert shuffled(spark, lambda: out.append(lifecycle.supersede_facts(m, batch, "better", MOMENT).facts) or noop(out[0])) < 1.5 * once
    found = {r["id"]: (r["status"], r["superseded_by"], r["supersedes"], r["supersede_reason"]) for r in out[0].where("id RLIKE '^[nf][0-3]$'").collect()}
    assert out[0].count() == 503 and found["f3"] == ("active", None, None, None)
    assert all(found[f"f{i}"] == ("superseded", f"n{i}", None, "better") and found[f"n{i}"] == ("active", None, [f"f{i}"], "better") for i in range(3))


def test_hops_of_a_search_find_what_no_hit_is(spark, wide):
    linked = F.when(F.col("id") == "f1", "s2").when(F.col("id") == "f3", "s1")
    m = wide.with_tables(facts=wide.facts.withColumns({"object_id": linked, "value_text": F.when(F.col("id") == "f2", F.lit("needle in hay")).otherwise(F.col("value_text"))})).settled()
    out = []
    out.extend(search.all_hits(m, SearchRequest("needle in hay", types=("fact",))).collect())
    assert {(r["record_id"], tuple(r["reasons"]), round(r["score"], 6)) for r in out} == {("f2", ("hybrid_keyword_match",), 1.4), ("f1", ("graph_expansion",), 0.63), ("f3", ("graph_expansion_bfs",), 0.2835)}


def graph_of_facts(spark, n):
    """Facts with ends of all sorts: shared, missing, blank, and many episodes; every ninth subject is an entity."""
    own = {"space_id": "'default'", "predicate": "'P'", "status": "'active'", "created_at": "timestamp'2026-01-01 00:00:00'", "updated_at": "timestamp'2026-01-01 00:00:00'"}
    ends = {"subject_id": f"concat('s', pmod(hash(k, 1), {n // 3}))", "object_id": f"CASE pmod(hash(k, 2), 4) WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('s', pmod(hash(k, 3), {n // 3})) END"}
    episodes = f"CASE WHEN k % 5 > 0 THEN transform(sequence(1, CAST(k % 5 AS int)), i -> concat('e', pmod(hash(k, i), {n})))  END"
    facts = rows(spark, schema.FACTS, n, id="concat('f', k)", value_text="if(k % 50 = 1, 'zebra crossing', 'quux')", supporting_episode_ids=episodes, **own, **ends)
    entities = rows(spark, schema.ENTITIES, n // 27, id="concat('s', 9 * k)", space_id="'default'", canonical_name="if(k % 2 = 0, 'zebra crossing', 'zebras cross')", created_at="timestamp'2026-01-01 00:00:00'", updated_at="timestamp'2026-01-01 00:00:00'")
    return Memory.empty(spark).with_tables(facts=facts, entities=entities).settled()


@pytest.mark.parametrize("most, words, query, types, min_score", [
    (100_000, 1 << 20, "zebra crossing", ("fact", "entity"), None), (5, 2, "zebra crossing", ("fact", "entity"), 0.2), (5, 1 << 20, "zebra crossing", ("fact",), None),
    (20, 1 << 20, "f1 s9 zebra crossing", ("entity",), None), (5, 1 << 20, "zebra crossing", ("fact", "entity"), 0.6), (5, 1 << 20, "absent", ("fact",), None),
])
def test_hops_equal_brute_force(spark, monkeypatch, most, words, query, types, min_score):
    monkeypatch.setattr(shared, "LIGHT", most)
    monkeypatch.setattr(shared, "WORDS", words, raising=False)
    m = graph_of_facts(spark, 900)
    kinds = tuple(dict.fromkeys((*types, "fact")))
    request = SearchRequest(query, types=kinds, min_score=min_score)
    direct = [r for r in search.direct_hits(m, request).collect()]
    facts = {r["id"]: r for r in m.facts.collect()}
    ends = {i: {x for x in (r["subject_id"], r["object_id"], *(r["supporting_episode_ids"] or ())) if x} for i, r in facts.items()}
    want = {(r["hit_type"], r["record_id"], tuple(r["reasons"])): r["score"] for r in direct}
    seeds, seen = [(k, r["score"]) for r in direct for k in r["keys"] if k], {r["record_id"] for r in direct if r["hit_type"] == "fact"}
    for reason in ("graph_expansion", "graph_expansion_bfs"):
        best = {}
        for k, s in seeds:
            best[k] = max(s, best.get(k, s))
        found = {i: search.DECAY * max(best[k] for k in own & best.keys()) for i, own in ends.items() if i not in seen and own & best.keys()}
        found = {i: s for i, s in found.items() if min_score is None or s >= min_score}
        want |= {("fact", i, (reason,)): s for i, s in found.items()}
        seen |= found.keys()
        seeds = [(k, s) for i, s in found.items() for k in (i, *ends[i])]
    got = search.all_hits(m, request).collect()
    assert len(got) == len(want) and {(r["hit_type"], r["record_id"], tuple(r["reasons"])): r["score"] for r in got} == want
    assert all(r["matched_text"] == facts[r["record_id"]]["value_text"] for r in got if r["hit_type"] == "fact")


def test_hops_move_facts_with_an_end_at_a_seed_only(spark):
    own = {"space_id": "'default'", "predicate": "'P'", "subject_id": "concat('s', k)", "object_id": "concat('o', k)", "value_text": "sha2(concat(k), 256)", "status": "'active'", "supporting_episode_ids": "array(concat('e', k))"}
    entities = rows(spark, schema.ENTITIES, 3, id="concat('s', k)", space_id="'default'", canonical_name="'zebra crossing'")
    m = Memory.empty(spark).with_tables(facts=rows(spark, schema.FACTS, 20_000, id="concat('f', k)", **own), entities=entities).settled()
    out = []
    assert shuffled(spark, lambda: out.extend(search.all_hits(m, SearchRequest("zebra crossing", types=("fact", "entity"))).collect())) < 100_000
    assert sorted(r["record_id"] for r in out) == ["f0", "f1", "f2", "s0", "s1", "s2"]


def test_hops_move_a_fact_once(spark, monkeypatch):
    monkeypatch.setattr(shared, "LIGHT", 5)
    own = {"space_id": "'default'", "predicate": "'P'", "subject_id": "concat('s', k % 2000)", "object_id": "concat('o', k)", "value_text": "sha2(concat(k), 256)", "status": "'active'", "supporting_episode_ids": "array(concat('e', k))"}
    entities = rows(spark, schema.ENTITIES, 2000, id="concat('s', k)", space_id="'default'", canonical_name="'zebra crossing'")
    m = Memory.empty(spark).with_tables(facts=rows(spark, schema.FACTS, 20_000, id="concat('f', k)", **own), entities=entities).settled()
    once = shuffled(spark, lambda: noop(m.facts.select(*search.ENDS).repartition(4, "id")))
    out = []
    assert shuffled(spark, lambda: out.append(search.all_hits(m, SearchRequest("zebra crossing", types=("fact", "entity"))).count())) < 1.5 * once
    assert out == [22_000]


def test_a_sieve_lets_its_own_pass_and_few_others(spark, monkeypatch):
    held = shared.cut(spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key")))
    others = spark.range(100_000).select(F.concat(F.lit("x"), "id").alias("key"))
    hit = shared.sieve(held, "key", 5000)(F.xxhash64("key"))
    assert held.where(hit).count() == 5000 and others.where(hit).count() < 10_000
    monkeypatch.setattr(shared, "WORDS", 4)
    assert held.where(shared.sieve(held, "key", 5000)(F.xxhash64("key"))).count() == 5000
    assert others.where(shared.sieve(held.limit(0), "key", 0)(F.xxhash64("key"))).isEmpty()


def test_a_save_writes_spaces_side_by_side(spark, tmp_path):
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before, seen = spark.conf.get(name, None), []
    episodes = rows(spark, schema.EPISODES, 1200, id="concat('e', k)", space_id="concat('space', k % 12)", content="'user 1 view'", source_id="'s'")
    memory = LazyMemory(spark, {"episodes": lambda: seen.append(spark.conf.get(name)) or episodes})
    store = Store(spark, str(tmp_path / "store"))
    store.save(memory, only=("episodes",))
    assert seen == [str(WRITERS)] and spark.conf.get(name, None) == before
    assert digests(store.table("episodes")) == digests(episodes) and len(store.log()["episodes"]) == 12
    assert all(f.name.endswith(".zstd.parquet") for f in (tmp_path / "store").rglob("*.parquet"))


def test_reads_build_the_tables_that_they_need_only(spark, tmp_path):
    for f in os.listdir(SF):
        os.symlink(f"{SF}/{f}", tmp_path / f)
    sf = str(tmp_path)
    built = lambda: next(made for key, (_, made) in derive._BUILT.items() if key[1] == sf)
    noop(QUERIES["search_semantic_episode"](spark, sf))
    assert built() == {"episodes", "sources"}
    noop(QUERIES["timeline_desc"](spark, sf))
    assert built() == {"episodes", "sources", "facts"}
    stored, derived = derive.stored_memory(spark, sf), derive.derived_memory(spark, sf)
    assert all(digests(df.select(schema.TABLES[name].names)) == digests(getattr(derived, name).select(schema.TABLES[name].names)) for name, df in stored.tables().items())
    assert built() == set(schema.TABLES)


def test_short_stored_rows_are_read_by_many_tasks(spark, tmp_path):
    episodes = rows(spark, schema.EPISODES, 250_000, id="concat('e', k)", space_id="'default'", content="'user 1 view'", source_id="'s'").coalesce(1)
    store = Store(spark, str(tmp_path / "store"))
    store.save(Memory.empty(spark).with_tables(episodes=episodes), only=("episodes",))
    assert store.table("episodes").rdd.getNumPartitions() >= 3 and store.table("episodes").count() == 250_000 and store.table("facts").isEmpty()
