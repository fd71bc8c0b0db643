"""Writes: batches of episodes, entities and facts become another memory, with revisions appended.

Every write takes the whole batch as a DataFrame, checks it, and returns a Memory; nothing is
kept of a batch that fails. Row order within a batch is the column `pos`; row i is written at
`now` plus i microseconds, so that later rows are later in knowledge time.
"""

from __future__ import annotations

import json
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.errors import ENTITY_NOT_FOUND, FACT_NOT_FOUND, INPUT_INVALID, LIFECYCLE_INVALID, RecordError
from palimpsest.functions.text import blank_to_null, distinct_texts, entity_id, source_id, strip, text_or_empty
from palimpsest.memory import Memory
from palimpsest.operators.temporal import at
from palimpsest.plans import schema
from palimpsest.plans.requests import space_of
from palimpsest.sources.shared import cut, with_numbers

SLOT_REASON = "cardinality_one_slot_replaced"
# Metadata keys that only the lifecycle writes.
RESERVED_KEYS = ("superseded_by", "supersedes", "supersede_reason", "duplicate_of", "_history")
_SLOT = ["space_id", "subject_id", "predicate"]


def _refuse(*checks: tuple) -> None:
    """Raise for the first row that fails any (rows, code, message, columns) check: one job for all of them.

    Instead of rows a check may give (rows, condition): those over the same rows share one pass.
    """
    passes: dict[int, tuple[DataFrame, list[Column]]] = {}
    for i, (bad, _, _, *columns) in enumerate(checks):
        rows, fails = bad if isinstance(bad, tuple) else (bad, F.lit(True))
        one = F.struct(F.lit(i).alias("i"), F.col("pos"), F.to_json(F.struct(*columns)).alias("d"))
        passes.setdefault(id(rows), (rows, []))[1].append(F.when(fails, one))
    parts = [rows.select(F.explode(F.array_compact(F.array(*found))).alias("r")).select("r.*") for rows, found in passes.values()]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    found = union.orderBy("pos", "i").head(1)
    if found:
        raise RecordError(*checks[found[0]["i"]][1:3], **json.loads(found[0]["d"]))


def _with(df: DataFrame, like, **more: str) -> DataFrame:
    """All columns of a schema (missing ones null), and some more with their types."""
    for name, kind in {**{f.name: f.dataType.simpleString() for f in like.fields}, **more}.items():
        df = df.withColumn(name, F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind))
    if "pos" not in df.columns:
        raise RecordError(INPUT_INVALID, "a batch needs the column pos")
    return df.withColumn("space_id", F.coalesce(blank_to_null(F.col("space_id")), F.lit(space_of(""))))


def _now(now: datetime) -> Column:
    return F.timestamp_micros(F.unix_micros(at(now)) + F.col("pos"))


def numbered(df: DataFrame, prefix: str, existing: DataFrame) -> DataFrame:
    """Ids `prefix_000001` and so on for rows without one, in the order of `pos`, after the greatest number that exists."""
    blank = F.col("id").isNull() | (F.col("id") == "")
    if df.where(blank).isEmpty():
        return df
    last = existing.agg(F.max(F.try_to_number(F.regexp_extract("id", f"^{prefix}_([0-9]+)$", 1), F.lit("999999999999999999")).cast("long"))).first()[0] or 0
    named = with_numbers(df.where(blank), ["pos"], "_n")
    return df.where(~blank).unionByName(named.withColumn("id", F.format_string(f"{prefix}_%06d", F.col("_n") + F.lit(last + 1))).drop("_n"))


def merged_json(a: Column, b: Column) -> Column:
    """Two JSON objects as one; where both have a key, the second's value stands."""
    kind = "map<string,variant>"
    both = F.map_zip_with(F.from_json(a, kind), F.from_json(b, kind), lambda _, x, y: F.coalesce(y, x))
    return F.when(a.isNull() | (a == ""), b).when(b.isNull() | (b == ""), a).otherwise(F.to_json(both))


def revisions_of(records: DataFrame, key: str, kind: Column, like) -> DataFrame:
    """Full copies of records at their last change; ids sort by time within a record."""
    order = F.lpad(F.unix_micros("updated_at").cast("string"), 20, "0")
    named = records.withColumn(key, F.col("id")).withColumn("revision_kind", kind).withColumn("tx_time", F.col("updated_at"))
    return named.withColumn("id", F.concat(F.lit("rev_"), F.col(key), F.lit("_"), order, F.lit("_"), "revision_kind")).select([f.name for f in like.fields])


# --- episodes
def ingest_episodes(memory: Memory, batch: DataFrame, now: datetime) -> Memory:
    """Add episodes and the sources they name; what is there already, unchanged, is no error."""
    rows = _with(batch, schema.EPISODES, source_kind="string", source_uri="string", source_external_ref="string", source_space_id="string", source_metadata_json="string")
    foreign = blank_to_null(F.col("source_space_id"))
    short = (strip(text_or_empty("kind")) == "") | (strip(text_or_empty("content")) == "")
    rows = numbered(cut(rows), "ep", memory.episodes).withColumn("group_id", text_or_empty("group_id"))
    rows = cut(resolved_sources(memory, rows).withColumn("ingested_at", _now(now)))
    sources = memory.sources.select(F.col("id").alias("source_id"), F.col("space_id").alias("_space"))
    _refuse(
        (rows.where(short), INPUT_INVALID, "kind and content of an episode are required", "id", "kind"),
        (rows.where(foreign.isNotNull() & (foreign != F.col("space_id"))), INPUT_INVALID, "the episode's source lies in a different space", "id", "space_id"),
        (rows.join(sources, "source_id").where("_space <> space_id"), LIFECYCLE_INVALID, "this source id is taken in another space", "source_id", "space_id"),
        (replay_conflicts(memory, rows), LIFECYCLE_INVALID, "this episode id is taken by different content", "id"),
    )
    first = Window.partitionBy("id").orderBy("pos")
    new = rows.join(memory.episodes.select("id"), "id", "left_anti").withColumn("_n", F.row_number().over(first)).where("_n = 1")
    named = rows.withColumn("_n", F.row_number().over(Window.partitionBy("source_id").orderBy("pos"))).where("_n = 1")
    made = named.select(
        F.col("source_id").alias("id"), "space_id", F.col("source_kind").alias("kind"), F.col("source_uri").alias("uri"), F.col("source_external_ref").alias("external_ref"),
        F.col("ingested_at").alias("created_at"), F.col("source_metadata_json").alias("metadata_json"),
    ).join(memory.sources.select("id"), "id", "left_anti")
    return memory.with_tables(sources=memory.sources.unionByName(made.select(memory.sources.columns)), episodes=memory.episodes.unionByName(new.select(memory.episodes.columns)))


def resolved_sources(memory: Memory, rows: DataFrame) -> DataFrame:
    """The source's given id, else one made of space, kind and reference; an older id without the space is kept where it exists."""
    rows = rows.withColumn("source_kind", F.when(blank_to_null(F.col("source_id")).isNull(), F.coalesce(blank_to_null(F.col("source_kind")), F.lit("inline"))).otherwise(F.col("source_kind")))
    ref = text_or_empty("source_external_ref")
    legacy = F.regexp_replace(source_id(F.lit(""), F.col("source_kind"), ref), "^src::", "src:")
    old = memory.sources.select(F.col("id").alias("_legacy"), F.col("space_id"), F.col("kind").alias("source_kind"), text_or_empty("external_ref").alias("_ref"), F.lit(True).alias("_old"))
    rows = rows.withColumn("_legacy", legacy).withColumn("_ref", ref).join(old, ["_legacy", "space_id", "source_kind", "_ref"], "left")
    made = F.when(F.col("_old"), F.col("_legacy")).otherwise(source_id(F.col("space_id"), F.col("source_kind"), ref))
    return rows.withColumn("source_id", F.coalesce(blank_to_null(F.col("source_id")), made)).drop("_legacy", "_ref", "_old")


def replay_conflicts(memory: Memory, rows: DataFrame) -> DataFrame:
    """Rows whose id exists, or came earlier in the batch, with another space, kind, content, source or group."""
    same = ["space_id", "kind", "content", "source_id", "group_id"]
    held = memory.episodes.select("id", F.struct(*(text_or_empty(c).alias(c) for c in same)).alias("_held"))
    own = F.struct(*(text_or_empty(c).alias(c) for c in same))
    first = F.first("_own").over(Window.partitionBy("id").orderBy("pos"))
    return rows.withColumn("_own", own).withColumn("_first", first).join(held, "id", "left").where("NOT (_own <=> coalesce(_held, _first))")


# --- entities
def upsert_entities(memory: Memory, batch: DataFrame, now: datetime) -> Memory:
    """Add or change entities: the name is replaced, aliases and metadata are merged; space, namespace and type stay."""
    rows = _with(batch, schema.ENTITIES)
    _refuse((rows.where((strip(text_or_empty("type")) == "") | (strip(text_or_empty("canonical_name")) == "")), INPUT_INVALID, "type and canonical_name of an entity are required", "id"))
    named = F.coalesce(blank_to_null(F.col("stable_key")), F.col("canonical_name"))
    rows = rows.withColumn("id", F.coalesce(blank_to_null(F.col("id")), entity_id(F.col("namespace"), F.col("type"), named)))
    held = memory.entities.select("id", *(F.col(c).alias(f"_{c}") for c in memory.entities.columns if c != "id"))
    rows = cut(rows.join(held, "id", "left").withColumn("updated_at", _now(now)))
    upto = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = Window.partitionBy("id").orderBy("pos")
    fixed = {"space_id": "this entity id is taken in another space", "namespace": "an entity keeps its namespace", "type": "an entity keeps its type"}
    before = {c: F.coalesce(blank_to_null(F.col(f"_{c}")), F.first(blank_to_null(F.col(c)), ignorenulls=True).over(upto)) for c in fixed}
    rows = rows.withColumns({f"_before_{c}": b for c, b in before.items()})
    _refuse(*((rows.where((F.col(f"_before_{c}") != F.col(c)) & (text_or_empty(c) != "")), LIFECYCLE_INVALID, message, "id") for c, message in fixed.items()))
    rows = rows.withColumns({c: F.coalesce(f"_before_{c}", c) for c in fixed})
    aliases = F.flatten(F.collect_list(F.coalesce("aliases", F.array().cast("array<string>"))).over(upto))
    rows = rows.withColumns(
        {
            "aliases": distinct_texts(F.concat(F.coalesce("_aliases", F.array().cast("array<string>")), aliases)),
            "stable_key": F.coalesce(F.last(blank_to_null(F.col("stable_key")), ignorenulls=True).over(upto), "_stable_key"),
            "duplicate_of": F.coalesce(F.last(F.col("duplicate_of"), ignorenulls=True).over(upto), "_duplicate_of"),
            "created_at": F.coalesce("_created_at", F.first("updated_at").over(upto)),
            "_new": F.col("_created_at").isNull() & (F.row_number().over(start) == 1),
            "_last": F.row_number().over(Window.partitionBy("id").orderBy(F.desc("pos"))) == 1,
        }
    )
    # Metadata of a run of changes to one entity is folded in order.
    each = F.collect_list(F.coalesce("metadata_json", F.lit(""))).over(upto)
    rows = rows.withColumn("metadata_json", F.aggregate(each, text_or_empty("_metadata_json"), merged_json))
    changed = cut(rows.select(*memory.entities.columns, "_new", "_last"))
    kept = memory.entities.join(changed.select("id").distinct(), "id", "left_anti").select(memory.entities.columns)
    more = revisions_of(changed, "entity_id", F.when(F.col("_new"), "assert").otherwise("update"), schema.ENTITY_REVISIONS)
    return memory.with_tables(entities=kept.unionByName(changed.where("_last").select(memory.entities.columns)), entity_revisions=memory.entity_revisions.unionByName(more))


# --- facts
def check_facts(memory: Memory, rows: DataFrame) -> None:
    """Everything that a fact refers to exists in its space, and nothing in it belongs to the lifecycle."""
    short = (strip(text_or_empty("predicate")) == "") | (strip(text_or_empty("subject_id")) == "")
    entities = memory.entities.select("id", "space_id")
    support = rows.select("pos", "space_id", F.explode("supporting_episode_ids").alias("episode_id"))
    episodes = memory.episodes.select(F.col("id").alias("episode_id"), "space_id")
    twice = rows.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("pos")))
    status = F.coalesce(blank_to_null(F.col("status")), F.lit(schema.ACTIVE))
    keys = F.map_keys(F.from_json("metadata_json", "map<string,string>"))

    def unknown(column: str) -> DataFrame:
        return rows.where(text_or_empty(column) != "").join(entities.withColumnRenamed("id", column), [column, "space_id"], "left_anti")

    _refuse(
        ((rows, short), INPUT_INVALID, "predicate and subject_id of a fact are required", "id"),
        ((rows, F.coalesce(F.size("supporting_episode_ids"), F.lit(0)) < 1), INPUT_INVALID, "a fact needs a supporting episode", "id"),
        (unknown("subject_id"), ENTITY_NOT_FOUND, "entity not found in the fact's space (subject)", "subject_id", "space_id"),
        (unknown("object_id"), ENTITY_NOT_FOUND, "entity not found in the fact's space (object)", "object_id", "space_id"),
        (support.join(episodes, ["episode_id", "space_id"], "left_anti"), INPUT_INVALID, "no such supporting episode in the fact's space", "episode_id", "space_id"),
        (rows.join(memory.facts.select("id"), "id", "left_semi"), LIFECYCLE_INVALID, "this fact id already exists", "id"),
        (twice.where("_n > 1"), LIFECYCLE_INVALID, "this fact id already exists", "id"),
        ((rows, ~status.isin(*schema.STATUSES)), INPUT_INVALID, "not a status of facts", "id", "status"),
        ((rows, status != schema.ACTIVE), LIFECYCLE_INVALID, "status is lifecycle-managed: supersede or retract the fact", "id", "status"),
        ((rows, F.arrays_overlap(keys, F.array(*map(F.lit, RESERVED_KEYS)))), LIFECYCLE_INVALID, "the metadata has a lifecycle-managed key", "id"),
        ((rows, ~F.col("cardinality").isin("one", "many")), INPUT_INVALID, "cardinality is neither one nor many", "id", "cardinality"),
        ((rows, F.col("valid_from") >= F.col("valid_to")), INPUT_INVALID, "the validity interval is empty", "id"),
    )


def slot_replacements(current: DataFrame, new: DataFrame) -> DataFrame:
    """(old_id, new_id, new_from, new_at): for each fact the first later fact of cardinality one that takes its slot.

    A validity changes only when its fact is superseded, so the first later fact of the slot that
    overlaps it is the one. The facts of a slot are swept in the order of `pos`: those not yet taken
    are held, and a fact of cardinality one takes those it overlaps, so no pairs are listed and a
    slot of any length streams through. `current` holds active facts (pos -1); both have the
    columns of the slot, validity, id and pos.
    """
    narrow = ["id", *_SLOT, "valid_from", "valid_to"]
    never = F.lit(None).cast("timestamp")
    old = current.select(*narrow, F.lit(-1).cast("long").alias("pos"), F.lit(False).alias("one"), never.alias("created_at"))
    made = new.select(*narrow, F.col("pos").cast("long"), (F.col("cardinality") == "one").alias("one"), "created_at")
    taking = new.where("cardinality = 'one'").select(_SLOT).distinct()
    rows = old.unionByName(made).join(taking, _SLOT, "left_semi")
    micros = [F.unix_micros(c).alias(c) for c in ("valid_from", "valid_to", "created_at")]
    parts = int(new.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    swept = rows.select(*_SLOT, "pos", "id", "one", *micros).repartition(parts, *_SLOT).sortWithinPartitions(*_SLOT, "pos", "id")
    found = swept.mapInArrow(_sweep, "old_id string, new_id string, new_from long, new_at long")
    return found.select("old_id", "new_id", F.timestamp_micros("new_from").alias("new_from"), F.timestamp_micros("new_at").alias("new_at"))


def _sweep(batches):
    """Over rows (slot, pos, id, one, from, to, made) in slot and pos order: (old_id, new_id, from, made) of each fact taken."""
    slot, held = None, []
    for batch in batches:
        taken: list[tuple] = []
        for *own, _, fact, one, start, end, made in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own != slot:
                slot, held = own, []
            if one:
                rest = []
                for x in held:
                    apart = (x[2] is not None and start is not None and x[2] <= start) or (x[1] is not None and end is not None and x[1] >= end)
                    if apart:
                        rest.append(x)
                    else:
                        taken.append((x[0], fact, start, made))
                held = rest
            held.append((fact, start, end))
        if taken:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*taken, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["old_id", "new_id", "new_from", "new_at"])


def clipped_to(new_from: Column) -> Column:
    """A validity that began before the replacement's ends where that begins, if that lies inside."""
    inside = new_from.isNotNull() & (F.col("valid_from").isNull() | (F.col("valid_from") < new_from)) & (F.col("valid_to").isNull() | (new_from < F.col("valid_to")))
    return F.when(inside, new_from).otherwise(F.col("valid_to"))


def replaced(rows: DataFrame, reason: str) -> DataFrame:
    """Facts with (new_id, new_from, new_at) of what takes their place, if anything does, as they are then."""
    life = {"status": F.lit(schema.SUPERSEDED), "valid_to": clipped_to(F.col("new_from")), "updated_at": F.col("new_at"), "superseded_by": F.col("new_id"), "supersede_reason": F.lit(reason)}
    return rows.withColumns({c: F.when(F.col("new_id").isNotNull(), v).otherwise(F.col(c)) for c, v in life.items()})


def assert_facts(memory: Memory, batch: DataFrame, now: datetime) -> Memory:
    """Add facts; those of cardinality one supersede what is active in their slot and overlaps them."""
    rows = cut(numbered(_with(batch, schema.FACTS, cardinality="string"), "fact", memory.facts))
    rows = rows.withColumn("cardinality", F.coalesce(blank_to_null(strip(F.col("cardinality"))), F.lit("many")))
    check_facts(memory, rows)
    rows = rows.withColumns({"created_at": _now(now), "updated_at": _now(now), "status": F.lit(schema.ACTIVE), "object_id": blank_to_null(F.col("object_id")), "supporting_episode_ids": distinct_texts(F.col("supporting_episode_ids"))})
    columns = memory.facts.columns
    if rows.where("cardinality = 'one'").isEmpty():  # nothing takes a slot: no fact is looked at
        fresh = rows.select(columns)
        return memory.with_tables(facts=memory.facts.unionByName(fresh), fact_revisions=memory.fact_revisions.unionByName(revisions_of(fresh, "fact_id", F.lit("assert"), schema.FACT_REVISIONS)))
    taken = cut(slot_replacements(memory.facts.where(F.col("status") == schema.ACTIVE), rows))
    fresh = rows.join(taken.groupBy(F.col("new_id").alias("id")).agg(F.sort_array(F.collect_list("old_id")).alias("_old")), "id", "left")
    fresh = fresh.withColumns({"supersedes": F.col("_old"), "supersede_reason": F.when(F.col("_old").isNotNull(), SLOT_REASON)}).select(columns)
    marked = replaced(memory.facts.unionByName(fresh).join(taken.withColumnRenamed("old_id", "id"), "id", "left"), SLOT_REASON)
    facts, gone = marked.select(columns), marked.where("new_id IS NOT NULL").select(columns)
    more = revisions_of(fresh, "fact_id", F.lit("assert"), schema.FACT_REVISIONS).unionByName(revisions_of(gone, "fact_id", F.lit("auto_supersede"), schema.FACT_REVISIONS))
    return memory.with_tables(facts=facts, fact_revisions=memory.fact_revisions.unionByName(more))


def supersede_facts(memory: Memory, batch: DataFrame, reason: str, now: datetime) -> Memory:
    """Replace facts by new ones of the same space, subject and predicate; `old_id` names the one replaced.

    A fact is replaced once: a batch that names it twice is refused, and so is one that replaces a fact it brings.
    """
    rows = _with(batch, schema.FACTS, old_id="string", cardinality="string")
    rows = cut(numbered(rows, "fact", memory.facts))
    old = memory.facts.select(F.col("id").alias("old_id"), F.col("status").alias("_status"), *(F.col(c).alias(f"_{c}") for c in _SLOT), F.lit(True).alias("_there"))
    met = cut(rows.select("old_id", "id", "pos", *_SLOT).join(old, "old_id", "left"))
    there = F.col("_there").isNotNull()
    _refuse(
        ((met, ~there), FACT_NOT_FOUND, "fact not found", "old_id"),
        (met.withColumn("_n", F.row_number().over(Window.partitionBy("old_id").orderBy("pos"))).where("_n > 1"), LIFECYCLE_INVALID, "the batch names this superseded fact already", "old_id"),
        ((met, F.col("_status") == schema.RETRACTED), LIFECYCLE_INVALID, "the fact was retracted", "old_id"),
        ((met, F.col("_status") == schema.SUPERSEDED), LIFECYCLE_INVALID, "the fact was superseded before", "old_id"),
        ((met, F.col("space_id") != F.col("_space_id")), LIFECYCLE_INVALID, "the replacement lies in another space", "old_id"),
        ((met, there & F.expr("NOT (subject_id <=> _subject_id AND predicate <=> _predicate)")), LIFECYCLE_INVALID, "subject and predicate of the replacement differ", "old_id"),
    )
    after = assert_facts(memory, rows.drop("old_id"), now)
    columns = after.facts.columns
    link = rows.select("old_id", F.col("id").alias("new_id"), F.col("valid_from").alias("new_from"), _now(now).alias("new_at"))
    # A fact is replaced or new, never both: one join marks either.
    old_side = link.select(F.col("old_id").alias("id"), "new_id", "new_from", "new_at", F.lit(None).cast("string").alias("_old"))
    new_side = link.select(F.col("new_id").alias("id"), *(F.lit(None).cast(link.schema[c].dataType).alias(c) for c in ("new_id", "new_from", "new_at")), F.col("old_id").alias("_old"))
    marked = replaced(after.facts.join(old_side.unionByName(new_side), "id", "left"), reason)
    is_new = F.col("_old").isNotNull()
    marked = marked.withColumns({"supersedes": F.when(is_new, F.array("_old")).otherwise(F.col("supersedes")), "supersede_reason": F.when(is_new, reason).otherwise(F.col("supersede_reason"))})
    facts, gone, fresh = marked.select(columns), marked.where("new_id IS NOT NULL").select(columns), marked.where(is_new).select(columns)
    more = revisions_of(gone, "fact_id", F.lit("supersede"), schema.FACT_REVISIONS).unionByName(revisions_of(fresh, "fact_id", F.lit("supersede_replacement"), schema.FACT_REVISIONS))
    return after.with_tables(facts=facts, fact_revisions=after.fact_revisions.unionByName(more))


def retract_facts(memory: Memory, batch: DataFrame, reason: str | None, now: datetime) -> Memory:
    """Retract the facts of the column `id` (with `reason`, if the batch has that column); those retracted already stay as they are."""
    rows = batch if "reason" in batch.columns else batch.withColumn("reason", F.lit(reason))
    _refuse((rows.join(memory.facts.select("id"), "id", "left_anti"), FACT_NOT_FOUND, "fact not found", "id"))
    once = rows.groupBy("id").agg(F.min("pos").alias("pos"), F.min_by("reason", "pos").alias("reason"))
    columns = memory.facts.columns
    gone = memory.facts.where(F.col("status") != schema.RETRACTED).join(once, "id")
    gone = gone.withColumns({"status": F.lit(schema.RETRACTED), "retracted_at": _now(now), "updated_at": _now(now), "retraction_reason": F.col("reason")}).select(columns)
    facts = memory.facts.join(gone.select("id"), "id", "left_anti").select(columns).unionByName(gone)
    return memory.with_tables(facts=facts, fact_revisions=memory.fact_revisions.unionByName(revisions_of(gone, "fact_id", F.lit("retract"), schema.FACT_REVISIONS)))


def seed_revisions(memory: Memory) -> Memory:
    """Revisions for records that have none of these yet: the first state of facts that changed, and what is current."""
    facts, life = memory.facts, {"status": F.lit(schema.ACTIVE), "updated_at": F.col("created_at"), "retracted_at": F.lit(None).cast("timestamp"), "retraction_reason": F.lit(None).cast("string"),
        "superseded_by": F.lit(None).cast("string"), "supersedes": F.lit(None).cast("array<string>"), "supersede_reason": F.lit(None).cast("string")}
    changed = facts.where((F.col("status") != schema.ACTIVE) & (F.col("updated_at") > F.col("created_at")))

    def seeds(df: DataFrame, key: str, kind: str, suffix: str, like) -> DataFrame:
        named = df.withColumns({key: F.col("id"), "revision_kind": F.lit(kind), "tx_time": F.coalesce("updated_at", "created_at")})
        return named.withColumn("id", F.concat(F.lit("seed:"), F.col(key), F.lit(suffix))).select([f.name for f in like.fields])

    more = seeds(changed.withColumns(life), "fact_id", "migration_seed_initial", ":initial", schema.FACT_REVISIONS).unionByName(seeds(facts, "fact_id", "migration_seed", ":current", schema.FACT_REVISIONS))
    more = more.join(memory.fact_revisions.select("id"), "id", "left_anti").select(memory.fact_revisions.columns)
    own = seeds(memory.entities, "entity_id", "migration_seed", ":current", schema.ENTITY_REVISIONS).join(memory.entity_revisions.select("id"), "id", "left_anti").select(memory.entity_revisions.columns)
    return memory.with_tables(fact_revisions=memory.fact_revisions.unionByName(more), entity_revisions=memory.entity_revisions.unionByName(own))


def inferred_observed_at(memory: Memory, rows: DataFrame, now: datetime) -> DataFrame:
    """Rows (id, observed_at, supporting_episode_ids) with observed_at given, else of the first supporting episode that has one, else now; and the basis."""
    held = memory.episodes.where("observed_at IS NOT NULL").select(F.col("id").alias("_episode"), F.col("observed_at").alias("_at"))
    each = rows.select("id", F.posexplode("supporting_episode_ids").alias("_p", "_episode")).join(held, "_episode")
    first = each.groupBy("id").agg(F.min_by(F.struct("_at", "_episode"), "_p").alias("_f"))
    given = F.col("observed_at").isNotNull()
    basis = F.when(given, "explicit").when(F.col("_f").isNotNull(), "supporting_episode").otherwise("ingestion_time")
    out = rows.join(first, "id", "left").withColumn("observed_at_basis", basis).withColumn("observed_at_supporting_episode_id", F.when(~given, F.col("_f._episode")))
    return out.withColumn("observed_at", F.coalesce("observed_at", "_f._at", at(now))).drop("_f")


def ingest_batch(memory: Memory, now: datetime, *, episodes: DataFrame | None = None, entities: DataFrame | None = None, facts: DataFrame | None = None, entity_revisions: DataFrame | None = None, fact_revisions: DataFrame | None = None) -> Memory:
    """Episodes, then entities, then facts, all or nothing; revisions cannot be given."""
    for given in (entity_revisions, fact_revisions):
        if given is not None and not given.isEmpty():
            raise RecordError(LIFECYCLE_INVALID, "revisions cannot be ingested")
    out = memory
    for rows, write in ((episodes, ingest_episodes), (entities, upsert_entities), (facts, assert_facts)):
        if rows is not None:
            out = write(out, rows, now)
    return out
