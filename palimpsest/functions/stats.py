"""Exact percentiles by position: the value at int(p * (n - 1)) of the sorted ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.sources.shared import cut


def percentiles(df: DataFrame, column: str, shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """(percentile, value) of the non-null values.

    Equal values are counted where they are read, and the different ones dealt in ranges of the
    order, so a frequent value is one row. Only the ranges that hold a wanted place are read again.
    """
    counted = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("m"))
    ranged = cut(counted.repartitionByRange("value").sortWithinPartitions("value").withColumn("part", F.spark_partition_id()))
    sums, starts, n = {r["part"]: r["m"] for r in ranged.groupBy("part").agg(F.sum("m").alias("m")).collect()}, {}, 0
    for part in sorted(sums):
        starts[part] = n
        n += sums[part]
    places = [(p, int(p * (n - 1))) for p in shares] if n else []
    wanted = [(p, part, at - starts[part]) for p, at in places for part in sums if starts[part] <= at < starts[part] + sums[part]]
    upto = F.sum("m").over(Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    held = ranged.where(F.col("part").isin(*{part for _, part, _ in wanted})).withColumn("upto", upto) if wanted else ranged.limit(0).withColumn("upto", F.col("m"))
    few = F.broadcast(df.sparkSession.createDataFrame(wanted, "percentile double, part int, n long"))
    return held.join(few, "part").where("n >= upto - m AND n < upto").select("percentile", "value")


def percentile_of(values: list[float], share: float) -> float:
    """The same for a few values at hand; 0 of none."""
    return sorted(values)[int(share * (len(values) - 1))] if values else 0.0
