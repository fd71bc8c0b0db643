"""A memory derived from the star-schema tables of a folder: customers, orders, lines, texts, events.

Deterministic, so that every read has a counterpart in SQL over the same tables (see oracle_base.py).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.memory import LazyMemory, Memory
from palimpsest.plans import schema
from palimpsest.sources.shared import shared_dir
from palimpsest.sources.store import Store

CREATED = "timestamp'1995-01-01 00:00:00'"
RENAMED = "timestamp'1998-01-01 00:00:00'"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _as(df: DataFrame, like, **columns: str) -> DataFrame:
    """The columns of a schema from SQL expressions; those not named are null."""
    return df.select(*(F.expr(columns.get(f.name, "NULL")).cast(f.dataType).alias(f.name) for f in like.fields))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of the default space, and every fiftieth in a second one."""
    own = _table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", "o_custkey AS c", "o_orderstatus AS st", "o_orderpriority AS pr", "CAST(o_orderdate AS timestamp) AS d")
    default = own.selectExpr("*", "'default' AS sp", "'' AS pre")
    return default.unionByName(own.where("k % 50 = 0").selectExpr("*", "'other' AS sp", "'o:' AS pre"))


def _sources(episodes: DataFrame) -> DataFrame:
    kind = "CASE WHEN source_id LIKE '%src:orders:%' THEN 'orders' WHEN source_id LIKE 'src:documents:%' THEN 'documents' WHEN source_id LIKE 'src:conv:%' THEN 'chat' ELSE 'events' END"
    return _as(episodes.groupBy("source_id", "space_id").agg(F.min("ingested_at").alias("at")), schema.SOURCES, id="source_id", space_id="space_id", kind=kind, created_at="at")


def _entity_revisions(entities: DataFrame) -> DataFrame:
    first = {"entity_id": "id", "revision_kind": "'assert'", "tx_time": "created_at", "updated_at": "created_at", "id": "concat('entityrev_', id, ':1')"}
    same = {f.name: f.name for f in schema.ENTITIES.fields if f.name not in ("id", "updated_at")}
    return _as(entities, schema.ENTITY_REVISIONS, **same | first | {"canonical_name": "CASE WHEN updated_at > created_at THEN left(canonical_name, length(canonical_name) - 4) ELSE canonical_name END"}).unionByName(
        _as(entities.where("updated_at > created_at"), schema.ENTITY_REVISIONS, **same | {"id": "concat('entityrev_', id, ':2')", "entity_id": "id", "revision_kind": "'update'", "tx_time": "updated_at", "updated_at": "updated_at"})
    )


def _fact_revisions(facts: DataFrame) -> DataFrame:
    whole = {f.name: f.name for f in schema.FACTS.fields if f.name != "id"}
    fresh = {"status": "'active'", "valid_to": "NULL", "updated_at": "created_at", "retracted_at": "NULL", "retraction_reason": "NULL", "superseded_by": "NULL", "supersede_reason": "CASE WHEN supersedes IS NOT NULL THEN supersede_reason END"}
    return _as(facts, schema.FACT_REVISIONS, **whole | fresh | {"id": "concat('factrev_', id, ':1')", "fact_id": "id", "revision_kind": "'assert'", "tx_time": "created_at"}).unionByName(
        _as(facts.where("status <> 'active'"), schema.FACT_REVISIONS, **whole | {"id": "concat('factrev_', id, CASE status WHEN 'superseded' THEN ':2' ELSE ':3' END)", "fact_id": "id", "revision_kind": "CASE status WHEN 'superseded' THEN 'auto_supersede' ELSE 'retract' END", "tx_time": "updated_at"})
    )


def derived_memory(spark: SparkSession, sf_dir: str) -> Memory:
    """The six tables."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    read = lambda name: _table(spark, sf_dir, name)
    orders = _orders(spark, sf_dir)
    customers = read("customer")

    ep = schema.EPISODES
    episodes = (
        _as(orders.join(customers.selectExpr("c_custkey AS c", "c_mktsegment"), "c"), ep, id="concat(pre, 'ep:order:', k)", space_id="sp", kind="'order'",
            content="concat('order ', k, ' status ', st, ' priority ', pr)", source_id="concat(pre, 'src:orders:', pr)", group_id="concat('segment:', c_mktsegment)", observed_at="d", ingested_at="d + INTERVAL 1 DAY")
        .unionByName(_as(read("conversations"), ep, id="concat('ep:conv:', conv_id, ':', turn)", space_id="'default'", kind="'message'", content="text", source_id="concat('src:conv:', conv_id)", group_id="concat('conv:', conv_id)",
            observed_at="timestamp'2024-01-01 00:00:00' + make_dt_interval(CAST(conv_id AS int), 0, CAST(turn AS int), 0)", ingested_at="timestamp'2024-01-01 01:00:00' + make_dt_interval(CAST(conv_id AS int), 0, CAST(turn AS int), 0)"))
        .unionByName(_as(read("documents"), ep, id="concat('ep:doc:', doc_id)", space_id="'default'", kind="'document'", content="text", source_id="concat('src:documents:', source)", group_id="concat('lang:', lang)",
            ingested_at="timestamp'2024-02-01 00:00:00' + make_dt_interval(0, 0, CAST(doc_id AS int), 0)"))
        .unionByName(_as(read("events"), ep, id="concat('ep:event:', event_id)", space_id="'default'", kind="event_type", content="concat('user ', user_id, ' ', event_type)", source_id="'src:events'", group_id="'events'",
            observed_at="CAST(ts AS timestamp)", ingested_at="CAST(ts AS timestamp) + INTERVAL 5 MINUTES"))
    )

    en = schema.ENTITIES
    renamed = "c_custkey % 10 = 0"
    named = {"created_at": CREATED, "updated_at": CREATED, "space_id": "'default'", "namespace": "''"}
    customer = {"type": "'Customer'", "canonical_name": f"CASE WHEN {renamed} THEN concat(c_name, ' Ltd') ELSE c_name END", "aliases": "array(c_mktsegment)", "updated_at": f"CASE WHEN {renamed} THEN {RENAMED} ELSE {CREATED} END"}
    elsewhere = customers.join(orders.where("sp = 'other'").selectExpr("c AS c_custkey").distinct(), "c_custkey", "left_semi")
    entities = (
        _as(customers, en, **named | customer | {"id": "concat('customer:', c_custkey)"})
        .unionByName(_as(elsewhere, en, **named | customer | {"id": "concat('o:customer:', c_custkey)", "space_id": "'other'"}))
        .unionByName(_as(read("supplier"), en, **named, id="concat('supplier:', s_suppkey)", type="'Supplier'", canonical_name="s_name", aliases="array()"))
        .unionByName(_as(read("nation"), en, **named, id="concat('nation:', n_nationkey)", type="'Nation'", canonical_name="n_name", aliases="array()"))
        .unionByName(_as(read("region"), en, **named, id="concat('region:', r_regionkey)", type="'Region'", canonical_name="r_name", aliases="array()"))
        .unionByName(_as(read("part"), en, **named, id="concat('part:', p_partkey)", type="'Part'", canonical_name="p_name", aliases="array()"))
    )

    fa = schema.FACTS
    located = {"space_id": "'default'", "predicate": "'LOCATED_IN'", "status": "'active'", "created_at": "timestamp'1995-01-02 00:00:00'", "updated_at": "timestamp'1995-01-02 00:00:00'", "confidence": "1.0"}
    of_customer = customers.join(orders.where("sp = 'default'").groupBy(F.col("c").alias("c_custkey")).agg(F.min("k").alias("k")), "c_custkey")
    slot = Window.partitionBy("sp", "c").orderBy("d", "k")
    chain = orders.select("*", F.lead("d").over(slot).alias("nd"), F.lead("k").over(slot).alias("nk"), F.lag("k").over(slot).alias("pk"))
    lines = read("lineitem")
    supplies = lines.groupBy("l_suppkey", "l_partkey").agg(F.sort_array(F.collect_set(F.expr("concat('ep:order:', l_orderkey)"))).alias("eps"), F.min(F.expr("CAST(l_shipdate AS timestamp)")).alias("d"))
    unique = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate")
    returned = lines.where("l_returnflag = 'R'").withColumn("n", F.row_number().over(unique)).join(orders.where("sp = 'default'").selectExpr("k AS l_orderkey", "c"), "l_orderkey").withColumn("d", F.expr("CAST(l_shipdate AS timestamp)"))
    facts = (
        _as(of_customer, fa, **located, id="concat('fact:located:customer:', c_custkey)", subject_id="concat('customer:', c_custkey)", object_id="concat('nation:', c_nationkey)", supporting_episode_ids="array(concat('ep:order:', k))")
        .unionByName(_as(read("supplier"), fa, **located, id="concat('fact:located:supplier:', s_suppkey)", subject_id="concat('supplier:', s_suppkey)", object_id="concat('nation:', s_nationkey)", supporting_episode_ids="array('ep:doc:0')"))
        .unionByName(_as(read("nation"), fa, **located, id="concat('fact:located:nation:', n_nationkey)", subject_id="concat('nation:', n_nationkey)", object_id="concat('region:', n_regionkey)", supporting_episode_ids="array('ep:doc:0')"))
        .unionByName(_as(chain, fa, id="concat(pre, 'fact:order:', k)", space_id="sp", predicate="'LATEST_ORDER_STATUS'", subject_id="concat(pre, 'customer:', c)", value_text="st", confidence="1.0",
            status="CASE WHEN nk IS NULL THEN 'active' ELSE 'superseded' END", valid_from="d", valid_to="CASE WHEN nd > d THEN nd END", observed_at="d", created_at="d + INTERVAL 1 DAY", updated_at="coalesce(nd, d) + INTERVAL 1 DAY",
            supporting_episode_ids="array(concat(pre, 'ep:order:', k))", superseded_by="CASE WHEN nk IS NOT NULL THEN concat(pre, 'fact:order:', nk) END", supersedes="CASE WHEN pk IS NOT NULL THEN array(concat(pre, 'fact:order:', pk)) END",
            supersede_reason="CASE WHEN nk IS NOT NULL OR pk IS NOT NULL THEN 'cardinality_one_slot_replaced' END"))
        .unionByName(_as(supplies, fa, id="concat('fact:supplies:', l_suppkey, ':', l_partkey)", space_id="'default'", predicate="'SUPPLIES'", subject_id="concat('supplier:', l_suppkey)", object_id="concat('part:', l_partkey)", confidence="1.0",
            status="'active'", observed_at="d", created_at="d + INTERVAL 1 DAY", updated_at="d + INTERVAL 1 DAY", supporting_episode_ids="eps"))
        .unionByName(_as(returned, fa, id="concat('fact:returned:', l_orderkey, ':', n)", space_id="'default'", predicate="'RETURNED'", subject_id="concat('customer:', c)", object_id="concat('part:', l_partkey)", confidence="1.0",
            status="'retracted'", observed_at="d", created_at="d + INTERVAL 1 DAY", updated_at="d + INTERVAL 30 DAYS", retracted_at="d + INTERVAL 30 DAYS", retraction_reason="'returned'", supporting_episode_ids="array(concat('ep:order:', l_orderkey))"))
    )
    return Memory(_sources(episodes), episodes, entities, facts, _fact_revisions(facts), _entity_revisions(entities))


#: For each session and folder the store's path and the tables built there.
_BUILT: dict[tuple, tuple[str, set[str]]] = {}


def stored_memory(spark: SparkSession, sf_dir: str) -> Memory:
    """The derived memory from a store in the shared folder; each table is built at its first use, once a session for the files as they are now."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    files = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    listed = files.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(files)
    key = (spark.sparkContext.applicationId, sf_dir, tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in listed)))
    path, built = _BUILT.setdefault(key, (f"{shared_dir(spark)}/memory-{uuid.uuid4().hex}", set()))
    own = {"sources": lambda: _sources(stored.episodes), "fact_revisions": lambda: _fact_revisions(stored.facts), "entity_revisions": lambda: _entity_revisions(stored.entities)}

    def table(name: str) -> DataFrame:
        if name not in built:
            df = own[name]() if name in own else getattr(derived_memory(spark, sf_dir), name)
            Store(spark, path).save(Memory.empty(spark).with_tables(**{name: df}), only=(name,))
            built.add(name)
        return Store(spark, path, read_only=True).table(name)

    stored = LazyMemory(spark, {name: (lambda name=name: table(name)) for name in schema.TABLES})
    return stored
