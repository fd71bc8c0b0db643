"""Approximate nearest neighbours (operator 3) with balanced posting lists.

Vectors are split into lists by recursive halving of a bounded sample; the lists' centroids are
searched through an in-memory graph. A vector is filed under its nearest list and, near a border,
under others within a distance ratio. A query opens the lists whose centroids lie within a
distance ratio of the nearest one; each (list, query) block is scored exactly by a matrix product.

Inner product becomes distance by one more coordinate, sqrt(M^2 - |x|^2), with M the largest
norm; scores come from the original vectors in double precision.

Copies of a vector are one point: all of them score alike, so only the k + 1 smallest ids of a
point can be among k nearest. That also keeps a vector that a third of all rows share from
filling a list. A list or a list's queries over `block` rows are dealt in blocks. Sizes on the
driver (sample, centroids, list counts) are bounded by parameters. The index is fitted on the
sample, but every vector is filed. There are at most MAX_LISTS lists, a bound of the fitted sample, so
beyond MAX_LISTS * LIST_SIZE vectors the lists grow with the table, and a query's work with them.
Recall against brute force is tested (at least 0.9).

Results for odd rows: vectors that are null or zero, hold null or non-finite components, or whose
length is not the table's most frequent one (the larger of equals) take no part, nor do rows
without an id; rows that repeat an id and its vector count once; an empty table, or one without
queries, gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.llm.common import table, written

SAMPLE, LIST_SIZE, MAX_LISTS, BLOCK = 20_000, 300, 4096, 4096
#: Filing: at most so many lists within this ratio of the nearest centroid's distance.
REPLICAS, FILE_RATIO = 3, 1.05
#: Searching: at most PROBES lists within this ratio, and the nearest LEAST ones in any case (in a
#: tight cluster, the ratio alone would tell equally good lists apart).
PROBES, PROBE_RATIO, LEAST = 64, 1.35, 12
DEGREE = 16


class CentroidGraph:
    """Centroids with links to their near ones and a few far ones, searched by a beam."""

    def __init__(self, centroids: np.ndarray, seed: int = 7):
        self.c = centroids.astype(np.float64)
        n, rng = len(centroids), np.random.default_rng(seed)
        degree = min(DEGREE, n - 1)
        links = np.zeros((n, degree + 8), np.int32)
        square = (self.c**2).sum(axis=1)
        for lo in range(0, n, 512):
            d = square - 2 * self.c[lo : lo + 512] @ self.c.T
            d[np.arange(len(d)), np.arange(lo, lo + len(d))] = np.inf
            links[lo : lo + 512, :degree] = np.argpartition(d, degree - 1, axis=1)[:, :degree] if degree else 0
        links[:, degree:-1] = rng.integers(0, n, (n, 7))  # far links
        links[:, -1] = (np.arange(n) + 1) % n  # a ring, so that every centroid can be reached
        self.links = links
        self.entries = np.unique(np.linspace(0, n - 1, min(n, 16)).astype(np.int64))

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(distances, centroid numbers) of about the `beam` nearest, nearest first, for each row."""
        n, rows = len(self.c), np.arange(len(q))[:, None]
        beam = min(beam, n)
        seen = np.zeros((len(q), n), bool)

        def away(ids):
            return ((self.c[ids] - q[:, None, :]) ** 2).sum(axis=2)

        ids = np.broadcast_to(self.entries, (len(q), len(self.entries))).copy()
        seen[:, self.entries] = True
        dist, done = away(ids), np.zeros(ids.shape, bool)
        wide = max(beam, len(self.entries))
        while True:
            # The best two unopened members of every beam are opened together.
            order = np.where(done, np.inf, dist)
            if not np.isfinite(order).any():
                break
            pick = np.argpartition(order, 1, axis=1)[:, :2] if order.shape[1] > 2 else np.argsort(order, axis=1)[:, :2]
            open_ = np.isfinite(np.take_along_axis(order, pick, 1))
            np.put_along_axis(done, pick, True, 1)
            new = self.links[np.take_along_axis(ids, pick, 1)].reshape(len(q), -1)
            fresh = ~seen[rows, new] & np.repeat(open_, self.links.shape[1], axis=1)
            seen[rows, np.where(fresh, new, new[:, :1])] |= fresh
            # A centroid that comes twice in one step counts once.
            sort = np.argsort(new, axis=1, kind="stable")
            ordered = np.take_along_axis(new, sort, 1)
            twice = np.zeros(new.shape, bool)
            np.put_along_axis(twice, sort[:, 1:], (ordered[:, 1:] == ordered[:, :-1]) & np.take_along_axis(fresh, sort, 1)[:, :-1], 1)
            d = np.where(fresh & ~twice, away(new), np.inf)
            ids, dist = np.hstack([ids, new]), np.hstack([dist, d])
            done = np.hstack([done, ~np.isfinite(d)])
            if dist.shape[1] > wide:
                keep = np.argpartition(dist, wide - 1, axis=1)[:, :wide]
                ids, dist, done = (np.take_along_axis(x, keep, 1) for x in (ids, dist, done))
        order = np.argsort(dist, axis=1, kind="stable")[:, :beam]
        return np.sqrt(np.maximum(np.take_along_axis(dist, order, 1), 0)), np.take_along_axis(ids, order, 1)


def halve(x: np.ndarray, most: int, seed: int = 7) -> np.ndarray:
    """Centroids of parts of at most `most` rows each: every cut divides its part at the median between two means."""
    rng, out, todo = np.random.default_rng(seed), [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= most:
            out.append(x[rows].mean(axis=0))
            continue
        a, b = x[rng.choice(rows, 2, replace=False)]
        for _ in range(6):
            side = x[rows] @ (b - a)
            order = np.argsort(side, kind="stable")
            a, b = x[rows[order[: len(rows) // 2]]].mean(axis=0), x[rows[order[len(rows) // 2 :]]].mean(axis=0)
        order = np.argsort(x[rows] @ (b - a), kind="stable")
        todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return np.array(out)


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _routed(points: DataFrame, shared, dim: int, most: float, beam: int, ratio: float, query: bool) -> DataFrame:
    """(h1, h2, vec binary, list) for every list a point is filed under, or a query opens."""
    names = ["h1", "h2", "vec", "list"]

    def run(batches):
        graph: CentroidGraph = shared.value
        for batch in batches:
            h1, h2 = (batch.column(i).to_numpy() for i in (0, 1))
            x = _matrix(batch.column(2), dim)
            for lo in range(0, len(x), 256):
                own = x[lo : lo + 256]
                square = (own**2).sum(axis=1)
                if query:  # the length of a query changes no order
                    bent = np.hstack([own * (most / np.sqrt(square))[:, None], np.zeros((len(own), 1))])
                else:
                    bent = np.hstack([own, np.sqrt(np.maximum(most * most - square, 0))[:, None]])
                d, c = graph.search(bent, beam)
                keep = d <= d[:, :1] * ratio
                if query:
                    keep |= np.arange(keep.shape[1]) < LEAST
                else:
                    keep &= np.arange(keep.shape[1]) < REPLICAS
                i, j = np.nonzero(keep)
                vec = [own[r].tobytes() for r in range(len(own))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h1[lo + i]), pa.array(h2[lo + i]), pa.array([vec[r] for r in i.tolist()], pa.binary()), pa.array(c[i, j].astype(np.int32))], names=names
                )

    return points.mapInArrow(run, "h1 long, h2 long, vec binary, list int")


def _scored(k: int, dim: int):
    """Scores of a block: for each query its k best points, by exact products."""

    def run(queries: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        q = np.frombuffer(b"".join(queries["vec"]), np.float64).reshape(-1, dim)
        p = np.frombuffer(b"".join(points["vec"]), np.float64).reshape(-1, dim)
        out = {n: [] for n in ("q1", "q2", "p1", "p2", "score")}
        for lo in range(0, len(q) if len(p) else 0, 512):
            own = q[lo : lo + 512]
            s = own @ p.T
            at = np.argpartition(-s, k - 1, axis=1)[:, :k] if len(p) > k else np.broadcast_to(np.arange(len(p)), s.shape)
            i, j = np.repeat(np.arange(len(own)), at.shape[1]), at.ravel()
            # Summed once more in a fixed order: the same two vectors score alike in any block.
            out["score"].append((own[i] * p[j]).sum(axis=1))
            for name, frame, rows in (("q1", queries["h1"], i + lo), ("q2", queries["h2"], i + lo), ("p1", points["h1"], j), ("p2", points["h2"], j)):
                out[name].append(frame.to_numpy()[rows])
        return pd.DataFrame({n: np.concatenate(x) if x else np.empty(0, np.float64 if n == "score" else np.int64) for n, x in out.items()})

    return run


def nearest(
    vectors: DataFrame, is_query: Column, *, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, list_size: int = LIST_SIZE, probes: int = PROBES, probe_ratio: float = PROBE_RATIO, block: int = BLOCK
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of `is_query` (over column `id`) its k nearest found among the other rows."""
    spark = vectors.sparkSession
    nothing = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    vec = F.col("vec")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vec")).where("id IS NOT NULL AND vec IS NOT NULL")
    sound = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = rows.where(F.coalesce(sound, F.lit(False)) & F.exists(vec, lambda v: v != 0))
    dims = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if not dims:
        return nothing
    dim = dims["dim"]
    # Two hashes (96 bits) name a point; -0.0 and 0.0 are one value.
    plain = F.transform(vec, lambda v: v + F.lit(0.0))
    rows = rows.where(F.size("vec") == dim).select("id", plain.alias("vec"))
    rows = rows.select("id", "vec", F.xxhash64("vec").alias("h1"), F.hash("vec").cast("long").alias("h2"))
    ids = written(rows.select("id", "h1", "h2").distinct(), "ann-ids")
    points = written(rows.dropDuplicates(["h1", "h2"]).select("h1", "h2", "vec"), "ann-points")
    norms = points.agg(F.count("*").alias("n"), F.max(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v * v)).alias("m")).first()
    n, most = norms["n"], float(np.sqrt(norms["m"]))

    chosen = points.orderBy(F.xxhash64("h1", "h2"), "h1", "h2").limit(sample).select("vec").toArrow()  # bounded by `sample`
    x = _matrix(chosen.column("vec").combine_chunks(), dim)
    bent = np.hstack([x, np.sqrt(np.maximum(most * most - (x**2).sum(axis=1), 0))[:, None]])
    lists = min(MAX_LISTS, max(1, -(-n // list_size)))
    graph = CentroidGraph(halve(bent, max(1, -(-len(bent) // lists))))
    shared = spark.sparkContext.broadcast(graph)

    filed = written(_routed(points, shared, dim, most, 2 * REPLICAS + 2, FILE_RATIO, False), "ann-lists")
    queries = ids.where(is_query)
    wanted = points.join(queries.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi").select("h1", "h2", "vec")
    opened = written(_routed(wanted, shared, dim, most, probes, probe_ratio, True), "ann-queries")

    # One row a list, at most MAX_LISTS (twice that many leaves): how many blocks its points and queries need.
    blocks = lambda df, name: df.groupBy("list").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    sizes = F.broadcast(blocks(filed, "p").join(blocks(opened, "q"), "list"))

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64("h2", "h1"), F.col(own)).cast("int").alias(f"{own}b")
        return df.join(sizes, "list").select("h1", "h2", "vec", "list", mine, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(f"{other}b"))

    key = ["list", "pb", "qb"]
    found = dealt(opened, "q", "p").groupBy(*key).cogroup(dealt(filed, "p", "q").groupBy(*key)).applyInPandas(_scored(k + 1, dim), "q1 long, q2 long, p1 long, p2 long, score double")
    by_query = Window.partitionBy("q1", "q2")
    best = found.groupBy("q1", "q2", "p1", "p2").agg(F.max("score").alias("score"))
    best = best.withColumn("r", F.row_number().over(by_query.orderBy(F.desc("score"), "p1", "p2"))).where(F.col("r") <= k + 1)
    # Points become ids: the k + 1 smallest of each, and of those the k + 1 best of each query point.
    few = ids.withColumn("r", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))).where(F.col("r") <= k + 1)
    few = few.select(F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("id").alias("vec_id"))
    named = best.drop("r").join(few, ["p1", "p2"])
    order = [F.desc("score"), F.asc("vec_id")]
    named = named.withColumn("r", F.row_number().over(by_query.orderBy(*order))).where(F.col("r") <= k + 1)
    mine = queries.select(F.col("id").alias("query_id"), F.col("h1").alias("q1"), F.col("h2").alias("q2"))
    result = named.drop("r").join(mine, ["q1", "q2"]).where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return result.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
