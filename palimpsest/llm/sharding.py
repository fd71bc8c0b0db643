"""Sharding (operator 2): vector bin packing of bytes, tokens and rows.

Rows with equal texts form a group. Groups hash into a fixed number of bundles; a group that holds
more than a bundle's share of any dimension is its own item, and one that holds more than
`split_share` of a shard is cut into pieces by a hash of the id. Items go in order of their
largest share to the shard where the dot product of their vector with the residual capacity is
highest. The number of items is bounded by parameters, whatever the input, so this step runs on
the driver; rows meet their item again through a hash, without a shuffle of texts.

A shard's slots follow its items, and within an item the ids. An item's first slot is known from
the packing, so numbering needs one shuffle of narrow rows, by item; an item of many rows is
dealt in sub-ranges that are numbered apart.

The law is `bytes`: sizes of shards near equal (tokens and rows are balanced with them).

Results for odd rows: null and empty texts have size 1 and form one group; rows without an id are
placed by their text alone, and come first within their part; repeated rows each get a slot; an
empty table gives an empty table; other columns are ignored, whatever their names; ties go to the
lower shard, and within a part by id, size and checksum; a text of many megabytes is one row of that
size. A group of equal texts is cut by ids where it holds over half a shard in some dimension: left
whole, it could unbalance the shards.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.llm.common import table, written

#: Bundles a shard, and the share of a shard from which a group of equal texts is cut.
BUNDLES, SPLIT_SHARE = 512, 0.5
LAW = "bytes"
#: Weights of bytes, tokens and rows in the dot product: the law is kept first.
WEIGHTS = (16.0, 4.0, 1.0)


def pack(items: np.ndarray, shards: int, weights: tuple[float, ...] = WEIGHTS) -> np.ndarray:
    """The shard of each item; items: one row of non-negative sizes each, a weight for each column."""
    total = items.sum(axis=0).astype(float)
    share = items / np.maximum(total, 1) * shards  # in capacities of a shard
    residual = np.ones((shards, items.shape[1]))
    out = np.zeros(len(items), np.int64)
    for i in np.lexsort([np.arange(len(items)), -share.max(axis=1)]):
        # A shard that is full in some dimension has no room to offer there; it counts against it.
        fit = residual @ (share[i] * weights)
        out[i] = k = int(fit.argmax())
        residual[k] -= share[i]
    return out


def shard(docs: DataFrame, shards: int, *, id_col: str = "doc_id", text_col: str = "text", bundles: int = BUNDLES, split_share: float = SPLIT_SHARE) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of every row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.regexp_count(text, F.lit(r"\S+")).cast("long").alias("tokens"),
        F.xxhash64(text).alias("grp"),
        F.xxhash64(F.col(id_col).cast("string"), F.lit(id_col)).alias("own"),
    )
    # The text is read and hashed once; what follows works on narrow rows.
    rows = written(rows, "shard-rows")
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    total = rows.agg(*sums).first()
    if not total["rows"]:
        return rows.select(id_col, "size", "text_crc32", F.lit(LAW).alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    count = bundles * shards
    over = F.greatest(*(F.col(c) / F.lit(max(1, total[c])) for c in ("size", "tokens", "rows")))
    # Groups over a bundle's share: at most 3 * count of them, as each dimension has room for count.
    heavy = rows.groupBy("grp").agg(*sums).where(over > 1.0 / count).select("grp", over.alias("share"))
    cut, fine = split_share / shards, 1.0 / count
    # `piece`: what is placed as one; `part`: what is numbered as one.
    pieces = F.when(F.col("share") > cut, F.ceil(F.col("share") / fine)).otherwise(1).cast("long")
    parts = F.ceil(F.col("share") / fine).cast("long")
    heavy = heavy.select("grp", pieces.alias("pieces"), parts.alias("parts"))
    keyed = (
        rows.join(F.broadcast(heavy), "grp", "left")
        .withColumn("whole", F.col("parts").isNotNull())
        .withColumn("part", F.when(F.col("whole"), F.pmod("own", F.col("parts"))).otherwise(0))
        .withColumn("unit", F.when(F.col("whole"), F.col("grp")).otherwise(F.pmod("grp", F.lit(count))))
        .withColumn("piece", F.when(F.col("pieces") > 1, F.col("part")).otherwise(0))
        .drop("grp", "pieces", "parts", "tokens", "own")
    )
    weighed = rows.select("grp", "size", "tokens", "own").join(F.broadcast(heavy), "grp", "left")
    whole = F.col("parts").isNotNull()
    units = (
        weighed.groupBy(
            whole.alias("whole"),
            F.when(whole, F.col("grp")).otherwise(F.pmod("grp", F.lit(count))).alias("unit"),
            F.when(whole, F.pmod("own", F.col("parts"))).otherwise(0).alias("part"),
            F.when(F.col("pieces") > 1, F.pmod("own", F.col("parts"))).otherwise(0).alias("piece"),
        )
        .agg(*sums)
        .orderBy("whole", "unit", "part")
        .collect()  # bounded: count bundles, and parts of about 1 / count each for three dimensions
    )
    names: dict[tuple, int] = {}
    of = np.array([names.setdefault((u["whole"], u["unit"], u["piece"]), len(names)) for u in units])
    sizes = np.array([[u["size"], u["tokens"], u["rows"]] for u in units], np.int64)
    items = np.zeros((len(names), 3), np.int64)
    np.add.at(items, of, sizes)
    where = pack(items, shards)[of]
    order = np.lexsort([np.arange(len(units)), where])
    first = np.zeros(len(units), np.int64)
    before = np.cumsum(sizes[order, 2]) - sizes[order, 2]
    starts = {s: before[i] for i, s in reversed(list(enumerate(where[order].tolist())))}
    first[order] = before - np.array([starts[s] for s in where[order].tolist()])
    placed = spark.createDataFrame(
        [(u["whole"], u["unit"], u["part"], int(s), int(f)) for u, s, f in zip(units, where, first, strict=True)], "whole boolean, unit long, part long, shard int, first long"
    )
    in_part = F.row_number().over(Window.partitionBy("whole", "unit", "part").orderBy(F.col(id_col).asc_nulls_first(), "size", "text_crc32"))
    numbered = keyed.drop("piece").withColumn("at", in_part - 1)
    return numbered.join(F.broadcast(placed), ["whole", "unit", "part"]).select(
        id_col, "size", "text_crc32", F.lit(LAW).alias("law"), "shard", (F.col("first") + F.col("at")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), 8)
