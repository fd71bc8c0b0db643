"""SimHash near-duplicates (operator 10): 64-bit fingerprints linked by pigeonring filtering.

Four segments of 16 bits lie on a ring. If two fingerprints differ in at most 3 bits, then from
some segment on, the differences of 1, 2, 3 and 4 consecutive segments stay within 0, 1, 2 and 3
(3/4 a segment, rounded down). So the first segment A is equal; if the next one, B, is equal too,
A and B are a key; else B differs in one bit and the segment after it, C, in at most one, so one
half of B and one half of C are equal and make a key with A. That is 20 keys of 32 equal bits.
Fingerprints that share a key are tested for the chain, then for the whole distance.

No pairs are listed: a bucket of fingerprints with one key gives a spanning forest of its links,
at most one edge a fingerprint, and only different fingerprints are dealt (copies meet once, in
the map-side combine of the grouping). A bucket over `BUCKET` rows is dealt again, exactly, by
the same rule on the 32 bits that its key leaves free; such a second bucket has 48 equal bits and
so at most 65,536 fingerprints.

A wider budget (`wide` bits, at most 11) adds links that an exact test confirms: then some segment
differs in at most 2 bits, so both fingerprints lie within one bit of a common value there, and each
is dealt to the 17 values around its own in each segment. With it goes a sketch of the text's set of
`SHINGLE`-word shingles, the parities of 256 hash classes: where two sketches differ in more bits
than a Jaccard similarity of `JACCARD` allows sets of their sizes to differ, the pair is refused
without a look at the texts. A first round tests a spanning forest of each bucket by the similarity
of the whole sets; a second round tests every pair that the first has left in different components,
each in one bucket only, so no similar pair within `wide` bits is lost where a forest's own edge
fails the test. What the second round emits are pairs that both filters let through and no link
connects: near misses, not the pairs of a group.

Nodes are fingerprints (with wide links: texts), not ids: an id that comes with several texts links
none of them, and the least id of a component is looked up at the end.

Results for odd rows: a null or empty text, or one of white space, has fingerprint 0 and is
linked like any other; documents without an id get a fingerprint and the least id of those
linked to them, or null; an id that repeats with other texts gets a row for each, with its own
component; repeated rows stay repeated (ties have equal results); a text of many megabytes or a
single word is fingerprinted whole; an empty table gives an empty table; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.llm.common import map_texts, schema_of, table, written
from palimpsest.llm.components import connected_components

SEED = 42
BITS = 3
BUCKET = 4096
#: What the wide links must share: Jaccard similarity of sets of shingles of so many words.
SHINGLE, JACCARD = 5, 0.8
_SKETCH = ["n", "s0", "s1", "s2", "s3"]


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The SimHash of a whole text, as a signed 64-bit integer."""
    import xxhash

    # On bytes, lower() and split() know A-Z and the white space 09-0D and 20 only.
    w = text.encode().lower().split() if text else []
    if not w:
        return 0
    grams = zip(*(w[i:] for i in range(shingle)), strict=False) if len(w) >= shingle else [w]
    n = max(1, len(w) - shingle + 1)
    h = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, grams), repeat(SEED)), np.uint64, n)
    bits = np.unpackbits(h.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    whole = n // 255 * 255  # sums of up to 255 fit a byte
    ones = bits[whole:].sum(axis=0, dtype=np.uint8).astype(np.int64)
    if whole:
        ones += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, keep: list[str] | None = None) -> DataFrame:
    """(id, columns to keep, fp long) for every row."""

    def make():
        return lambda texts: [np.array([fingerprint(t, shingle) for t in texts], np.int64)]

    return map_texts(docs, make, schema_of("fp long"), [id_col, *(keep or [])], text_col)


def _ring_keys(value, bits: int, tag: int, col: bool):
    """The 20 keys of a `bits`-wide value: (tag * 32 + number) above bits/2 equal bits. For columns or numpy arrays."""
    q, h = bits // 4, bits // 8

    def cut(at: int, width: int):
        if col:
            return F.shiftrightunsigned(value, at).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        return value >> np.int64(at) & np.int64((1 << width) - 1)

    up = (lambda x, n: F.shiftleft(x, n)) if col else (lambda x, n: x << np.int64(n))
    join = (lambda x, y: x.bitwiseOR(y)) if col else (lambda x, y: x | y)
    number = (lambda n: F.lit(n << (bits // 2)).cast("long")) if col else (lambda n: np.int64(n << (bits // 2)))
    out = []
    for i in range(4):
        a, b, c = i * q, (i + 1) % 4 * q, (i + 2) % 4 * q
        first = up(cut(a, q), q)
        out.append(join(number(tag * 32 + len(out)), join(first, cut(b, q))))
        for b_half in (b, b + h):
            for c_half in (c, c + h):
                out.append(join(number(tag * 32 + len(out)), join(first, join(up(cut(b_half, h), h), cut(c_half, h)))))
    return out


def _free_positions() -> list[list[int]]:
    """For each of the 20 keys of 64 bits, the 32 bit positions that it leaves out."""
    out = []
    for i in range(4):
        a, b, c = i * 16, (i + 1) % 4 * 16, (i + 2) % 4 * 16
        used = [[*range(a, a + 16), *range(b, b + 16)]]
        used += [[*range(a, a + 16), *range(x, x + 8), *range(y, y + 8)] for x in (b, b + 8) for y in (c, c + 8)]
        out += [[p for p in range(64) if p not in set(u)] for u in used]
    return out


def near(x: np.ndarray, y, bits: int = BITS) -> np.ndarray:
    """Which fingerprints are within `bits` of one (or of those in the same place): the chain test, then the distance."""
    each = np.bitwise_count((x ^ y).view(np.uint16).reshape(-1, 4)).astype(np.int16)
    ring = np.concatenate([each, each[:, :3]], axis=1)
    ok = np.zeros(len(each), bool)
    for i in range(4):
        ok |= (np.cumsum(ring[:, i : i + 4], axis=1) <= np.arange(1, 5) * bits // 4).all(axis=1)
    found = np.nonzero(ok)[0]
    ok[found] = each[found].sum(axis=1) <= bits
    return ok


def _forest(fp: np.ndarray, node: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges that span the links within one bucket."""
    a, b, rest = [], [], np.arange(len(fp))
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            hit = near(fp[rest], fp[at])
            got = rest[hit]
            rest = rest[~hit]
            queue.extend(got.tolist())
            a.extend([int(node[at])] * len(got))
            b.extend(node[got].tolist())
    return a, b


def _linker(bucket: int | None):
    """Over rows (key, fp, node) in key order: edges (a, b, null key), or rows (fp, node, second key) of large buckets."""
    free = np.array(_free_positions(), np.int64)

    def made(a, b, key=None):
        key = pa.nulls(len(a), pa.int64()) if key is None else pa.array(key, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), key], names=["a", "b", "key"])

    def again(key, fp, node):
        at = free[int(key[0]) >> 32]
        rest = np.zeros(len(fp), np.int64)
        for k, p in enumerate(at.tolist()):
            rest |= (fp >> np.int64(p) & np.int64(1)) << np.int64(k)
        # The first key's 37 bits, the second key's number and its 16 bits, less the ring's own tag.
        for k in _ring_keys(rest, 32, 0, False):
            yield made(fp, node, (key[0] << np.int64(21)) | k)

    def run(batches):
        held = [np.empty(0, np.int64)] * 3
        large = None
        for batch in batches:
            rows = [c.to_numpy(zero_copy_only=False).astype(np.int64, copy=False) for c in batch.columns]
            if large is not None:
                more = int(np.searchsorted(rows[0], large, "right"))
                if more:
                    yield from again(*(r[:more] for r in rows))
                    rows = [r[more:] for r in rows]
                if not len(rows[0]):
                    continue
                large = None
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            if not len(rows[0]):
                continue
            last = int(np.searchsorted(rows[0], rows[0][-1], "left"))  # its bucket may go on
            held = [r[last:].copy() for r in rows]
            yield from buckets(*(r[:last] for r in rows))
            if bucket and len(held[0]) > bucket:
                yield from again(*held)
                large, held = held[0][0], [np.empty(0, np.int64)] * 3
        yield from buckets(*held)

    def buckets(key, fp, node):
        if len(key) < 2:
            return
        starts = np.r_[0, np.nonzero(np.diff(key))[0] + 1]
        size = np.diff(np.r_[starts, len(key)])
        two = starts[size == 2]
        hit = two[near(fp[two], fp[two + 1])]
        a, b = [node[hit]], [node[hit + 1]]
        for lo, n in zip(starts[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            if bucket and n > bucket:
                yield from again(key[lo : lo + n], fp[lo : lo + n], node[lo : lo + n])
            else:
                x, y = _forest(fp[lo : lo + n], node[lo : lo + n])
                a.append(np.array(x, np.int64))
                b.append(np.array(y, np.int64))
        if sum(map(len, a)):
            yield made(np.concatenate(a), np.concatenate(b))

    return run


def links(distinct: DataFrame, *, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) that connect exactly those fingerprints that links of at most 3 bits connect.

    `distinct` has each fingerprint once: (fp, node).
    """
    key = F.explode(F.array(*_ring_keys(F.col("fp"), 64, 0, True))).alias("key")
    dealt = distinct.select(key, "fp", "node")
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def step(rows: DataFrame, most: int | None) -> DataFrame:
        return rows.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_linker(most), "a long, b long, key long")

    first = written(step(dealt, bucket), "simhash-links")
    second = step(first.where("key IS NOT NULL").select("key", F.col("a").alias("fp"), F.col("b").alias("node")), None)
    return first.where("key IS NULL").select("a", "b").unionByName(second.select("a", "b"))


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The different shingles of a text, hashed and in order; a text of fewer words is one shingle."""
    import xxhash

    w = text.encode().lower().split() if text else []
    if not w:
        return np.empty(0, np.uint64)
    grams = zip(*(w[i:] for i in range(shingle)), strict=False) if len(w) >= shingle else [w]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, grams), repeat(SEED)), np.uint64))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _wide_keys(fp) -> list:
    """For each of the four segments its value and those one bit away, numbered by segment."""
    out = []
    for i in range(4):
        own = F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF).cast("long"))
        out += [own.bitwiseXOR(F.lit(x).cast("long")).bitwiseOR(F.lit(i << 16).cast("long")) for x in (0, *(1 << b for b in range(16)))]
    return out


def ones(x: np.ndarray) -> np.ndarray:
    """One-bits of signed integers; of those below zero too, whose absolute value is what bitwise_count looks at."""
    return np.bitwise_count(x.view(np.uint64))


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Parities of 256 classes of a set's hashes, as four integers. Those of two sets differ in no more bits than the sets in elements."""
    odd = np.bincount((shingles & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def sketched(docs: DataFrame, *, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, hash, fp, n, s0 to s3): fingerprint, and size and sketch of the set of shingles, of every row."""

    def make():
        def work(texts):
            sets = [shingle_set(t) for t in texts]
            marks = np.array([sketch(x) for x in sets]).reshape(-1, 4)
            return [np.array([fingerprint(t, shingle) for t in texts], np.int64), np.array([len(x) for x in sets], np.int64), *(np.ascontiguousarray(marks[:, k]) for k in range(4))]

        return work

    return map_texts(docs, make, schema_of("fp long, n long, s0 long, s1 long, s2 long, s3 long"), [id_col, "hash"], text_col)


def _wide_linker(bits: int, least: float, forest: bool):
    """Over rows (key, fp, node, component, n, sketch) in key order: edges (a, b) that both filters let through: a forest of each bucket, or all pairs of different components."""

    def made(a, b):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def alike(x, i, j):
        """Of index arrays of two sides, whether sizes and sketches allow the similarity."""
        apart = sum(ones(x[k][i] ^ x[k][j]).astype(np.int64) for k in range(5, 9))
        return apart * (1 + least) <= (x[4][i] + x[4][j]) * (1 - least) + 1e-9

    def spanned(x):
        fp, node, rest = x[1], x[2], np.arange(len(x[0]))
        while len(rest) > 1:
            queue, rest, a, b = [rest[0]], rest[1:], [], []
            while queue and len(rest):
                at = queue.pop()
                hit = ones(fp[rest] ^ fp[at]) <= bits
                hit[hit] = alike(x, rest[hit], at)
                got, rest = rest[hit], rest[~hit]
                queue.extend(got.tolist())
                a.append(np.full(len(got), node[at]))
                b.append(node[got])
            if sum(map(len, a)):
                yield made(np.concatenate(a), np.concatenate(b))

    def crossed(x):
        key, fp, node, part = x[0][0], x[1], x[2], x[3]
        own = fp >> np.int64(16 * (int(key) >> 16)) & np.int64(0xFFFF)
        value = key & np.int64(0xFFFF)
        _, of, size = np.unique(part, return_inverse=True, return_counts=True)
        # One of a pair of different components lies outside the bucket's largest.
        outside = np.nonzero(of != size.argmax())[0]
        step = max(1, 2_000_000 // len(fp))
        for lo in range(0, len(outside), step):
            some = outside[lo : lo + step]
            i, j = np.nonzero((ones(fp[some, None] ^ fp[None, :]) <= bits) & (part[some, None] != part[None, :]))
            i = some[i]
            # A pair may meet in several buckets: it counts in that of the least common value.
            differ = own[i] ^ own[j]
            low = differ & -differ
            first = np.where(differ == low, np.minimum(own[i], own[j]), np.minimum(own[i] ^ low, own[i] ^ differ ^ low))
            keep = np.nonzero(first == value)[0]
            keep = keep[alike(x, i[keep], j[keep])]
            if len(keep):
                yield made(node[i[keep]], node[j[keep]])

    def buckets(rows):
        key = rows[0]
        starts = np.r_[0, np.nonzero(np.diff(key))[0] + 1] if len(key) else np.empty(0, np.int64)
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(key)], strict=False):
            if hi - lo > 1:
                yield from (spanned if forest else crossed)([r[lo:hi] for r in rows])

    def run(batches):
        held = None
        for batch in batches:
            rows = [c.to_numpy(zero_copy_only=False).astype(np.int64, copy=False) for c in batch.columns]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            if len(rows[0]):
                last = int(np.searchsorted(rows[0], rows[0][-1], "left"))  # its bucket may go on
                held = [r[last:].copy() for r in rows]
                yield from buckets([r[:last] for r in rows])
        if held is not None:
            yield from buckets(held)

    return run


def _confirmed(edges: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of the edges whose sets of shingles are similar enough."""

    def run(batches):
        for batch in batches:
            pairs = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            keep = pa.array([jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= least for x, y in pairs], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    met = edges.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return met.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def similar_links(docs: DataFrame, texts: DataFrame, thin: DataFrame, wide: int, *, id_col: str, text_col: str, least: float = JACCARD) -> DataFrame:
    """Edges (a, b) that connect all different texts within `wide` bits whose sets of shingles are similar.

    `texts` has (fp, hash, best, node, sketch) of every different text, `thin` edges that hold anyway.
    """
    if not 0 <= wide < 12:
        raise ValueError("wide links are dealt out for 0 to 11 bits")
    texts = texts.where("fp <> 0")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def candidates(rows: DataFrame, forest: bool) -> DataFrame:
        dealt = rows.select(F.explode(F.array(*_wide_keys(F.col("fp")))).alias("key"), "fp", "node", "component", *_SKETCH)
        dealt = dealt.repartition(parts, "key").sortWithinPartitions("key")
        found = dealt.mapInArrow(_wide_linker(wide, least, forest), "a long, b long")
        return written(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "wide-candidates")

    def sets_of(edges: DataFrame) -> DataFrame:
        nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
        wanted = texts.join(nodes, "node", "left_semi").select("node", "hash", F.col("best.id").alias("first"))
        # One row of each text is read: that of its least id.
        held = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("own"))
        held = held.join(wanted, (F.col("own") == F.col("hash")) & F.col("id").eqNullSafe(F.col("first"))).select("node", "text")

        def make():
            return lambda found: [pa.array([shingle_set(t).tobytes() for t in found], pa.binary())]

        # Repeated rows give one set.
        return written(map_texts(held, make, schema_of("shingles binary"), ["node"], "text").dropDuplicates(["node"]), "wide-shingles")

    first = candidates(texts.withColumn("component", F.lit(0).cast("long")), True)
    held = written(_confirmed(first, sets_of(first), least), "wide-links")
    reached = connected_components(thin.unionByName(held))
    placed = texts.join(reached, "node", "left").select("fp", "node", F.coalesce("component", "node").alias("component"), *_SKETCH)
    second = candidates(placed, False).join(first, ["a", "b"], "left_anti")
    second = written(second, "wide-candidates")
    return held.unionByName(_confirmed(second, sets_of(second), least))


def _classed(docs: DataFrame, id_col: str, text_col: str, shingle: int, bucket: int, wide: int, hashed: bool) -> DataFrame:
    """(id, fp, hash, best) of every row: the least id of its component, or with hashes the least (no id, id, hash)."""
    own = docs.select(id_col, text_col, F.xxhash64(text_col).alias("hash")) if hashed else docs.select(id_col, text_col)
    if wide:
        own = sketched(own, id_col=id_col, text_col=text_col, shingle=shingle)
    else:
        own = fingerprints(own, id_col=id_col, text_col=text_col, shingle=shingle, keep=["hash"] if hashed else [])
    own = written(own, "fingerprints")
    doc_id = F.col(id_col).cast("long")
    key = ["fp", "hash"] if wide else ["fp"]
    best = F.struct(doc_id.isNull().alias("none"), doc_id.alias("id"), F.col("hash").alias("text")) if hashed else doc_id
    texts = own.groupBy(*key).agg(F.min(best).alias("best"), *(F.first(c).alias(c) for c in _SKETCH if wide))
    if wide:
        texts = written(texts.withColumn("node", F.monotonically_increasing_id()), "texts")
        of_fp = texts.groupBy("fp").agg(F.min("node").alias("node"))
        thin = links(of_fp, bucket=bucket)
        same = texts.join(of_fp.withColumnRenamed("node", "b"), "fp").where("node <> b").select(F.col("node").alias("a"), "b")
        thin = written(thin.unionByName(same), "thin-links")
        edges = thin.unionByName(similar_links(docs, texts, thin, wide, id_col=id_col, text_col=text_col))
    else:
        texts = texts.withColumn("node", F.col("fp"))
        edges = links(texts.select("fp", "node"), bucket=bucket)
    reached = connected_components(edges).join(texts.select("node", "best"), "node")
    least = reached.groupBy("component").agg(F.min("best").alias("linked"))
    classes = texts.join(reached.join(least, "component").select("node", "linked"), "node", "left")
    own = own.drop(*_SKETCH)
    return own.join(classes.select(*key, F.coalesce("linked", "best").alias("best")), key, "left")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bucket: int = BUCKET, wide: int = 0) -> DataFrame:
    """(id, fingerprint, component_id): one row a document with the least document id that links reach.

    With `wide` bits, texts of that distance whose shingles are similar are linked too.
    """
    text = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    found = _classed(docs, id_col, text_col, shingle, bucket, wide, bool(wide))
    return found.select(id_col, text, F.col("best.id" if wide else "best").alias("component_id"))


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bucket: int = BUCKET, wide: int = 0) -> DataFrame:
    """The rows of `docs` with one document of each component.

    It is the one of the least id. Of several texts with that id in a component the one of least
    hash stays, and of its repeated rows the one whose columns have the least hash. Rows without an
    id cannot be told apart by it and stay.
    """
    own, text = F.col(id_col).cast("long"), F.xxhash64(text_col)
    found = written(_classed(docs, id_col, text_col, shingle, bucket, wide, True), "near-duplicates")
    stays = (own == F.col("best.id")) & (F.col("hash") == F.col("best.text"))
    match = (own == F.col("__id")) & (text == F.col("__hash"))
    gone = found.where(~stays).select(own.alias("__id"), F.col("hash").alias("__hash")).distinct()
    kept = docs.join(gone, match, "left_anti")
    again = found.where(stays).groupBy(own.alias("__id"), F.col("hash").alias("__hash")).count().where("count > 1").drop("count")
    if again.isEmpty():
        return kept
    # Rows of one document differ in other columns only; a hash of all of them picks one.
    whole = F.xxhash64(F.to_json(F.struct(*docs.columns)))
    once = kept.join(again, match, "left_semi").withColumn("__row", whole).withColumn("__text", text)
    least = F.row_number().over(Window.partitionBy(own, "__text").orderBy("__row"))
    once = once.withColumn("__place", least).where("__place = 1").select(docs.columns)
    return kept.join(again, match, "left_anti").unionByName(once)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
