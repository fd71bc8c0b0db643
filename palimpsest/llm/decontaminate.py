"""Benchmark decontamination (operator 8) by latent semantic retrieval.

Passages are windows of `WINDOW` words, half overlapping, as TF-IDF vectors over the benchmark's
words (no other word can add to a product with an item). Document frequencies come from all
documents. A distributed randomised SVD of the passages of all documents gives the latent space:
each task counts the pairs of terms that its windows hold, and from them returns its share of
A'(A Omega), then of the small Gram matrix; those matrices of fixed size are summed by executors and
one of each meets the driver. Then every passage of every document is projected and compared with
the items by cosine. Candidates are checked against the words themselves: the longest common subsequence of
the item with the passage's surroundings, and the share of the item's answer words there, so that
rewordings are found and chance meetings of common words are not.

Texts are read and cut into words once: a table in the shared folder holds each document's words
as term numbers (2 bytes a word), and the later passes read that. Nothing is shuffled but counts.
The benchmark is a stated query set that goes to all tasks; over `block_items` items it is worked
off in blocks, each with its own table.

Results for odd rows: null or empty texts hold nothing; items without a word are not searched for;
items under `SHORT` words must occur word for word; rows without an id are searched and give rows
without an id; repeated rows and items each give their rows; of a document's passages that hold one
item the best counts (ties by answer, then cosine), so there is one row a document and item; a text
of many megabytes is searched whole, and a single long word is one word; empty tables give no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import CHUNK_CHARS, pieces, table, written

WINDOW, RANK, EXTRA = 48, 160, 16
BLOCK_ITEMS = 20_000
#: Documents whose shares of the matrices one task sums, and term rows of a matrix summed together.
FIT_DOCS, FIT_ROWS = 10_000, 128
#: Terms in more than this share of the documents weigh nothing.
COMMON = 0.02
#: Words handled at once.
STEP = 200_000
#: Least cosine of a candidate; least shares of the item in the common subsequence and of its answer words.
COSINE, LCS, ANSWER = 0.35, 0.7, 0.6
SHORT = 8
_NOT_WORD = re.compile(r"(?:[^\w\s]|_)+")


#: Bytes of plain texts: A-Z in lower case; without what is no letter, digit or space.
_PLAIN = bytes(range(65)) + b"abcdefghijklmnopqrstuvwxyz" + bytes(range(91, 256))
_PUNCTUATION = bytes(b for b in range(128) if not chr(b).isalnum() and not chr(b).isspace())


def normal_words(text: str | None) -> list[str]:
    """The words of a text in lower case, without characters that are no letters or digits; words of such characters alone are left out."""
    if not text:
        return []
    if text.isascii():
        return text.encode().translate(_PLAIN, _PUNCTUATION).decode().split()
    return _NOT_WORD.sub("", text.lower()).split()


#: A-Z in lower case, white space as blanks, for bytes.
_PLAIN_BLANKS = bytes(32 if chr(b).isspace() and b < 128 else _PLAIN[b] for b in range(256))
#: The ends of a blank and of a text among code points; what is dropped, and what was not met yet.
_BLANK, _END, _DROP, _NEW = 32, 0x110000, 0x110001, 0x110002


class Cutter:
    """The term numbers of the words of many texts at once, as normal_words() cuts them, without an object a word."""

    def __init__(self, number: dict[str, int]):
        self.words = pa.array([f"{w} " for w in number], pa.string())  # numbers follow the order of the words
        self.points = np.full(_END + 1, _NEW, np.uint32)
        self.points[_END] = _END

    def _mapped(self, points: np.ndarray) -> np.ndarray:
        """Code points of lower-case texts: blanks for white space, without those of no word."""
        out = self.points[points]
        if len(new := np.unique(points[out == _NEW])):
            for x in new.tolist():
                c = chr(x)
                self.points[x] = _BLANK if c.isspace() else x if c.isalnum() else _DROP
            out = self.points[points]
        return out[out != _DROP]

    def _wide(self, texts: list[str]) -> list[bytes]:
        """Texts that are not plain ASCII, cleaned."""
        lower = [t.lower() for t in texts]
        out: list[bytes] = []
        for lo, hi in pieces(lower):
            if hi == lo + 1:  # a long text by slices
                parts = [self._mapped(np.frombuffer(lower[lo][i : i + CHUNK_CHARS].encode("utf-32-le"), np.uint32)) for i in range(0, len(lower[lo]), CHUNK_CHARS)]
                out.append(b"".join(x.tobytes().decode("utf-32-le").encode() for x in parts))
                continue
            points = np.frombuffer("\0".join(lower[lo:hi]).encode("utf-32-le"), np.uint32).copy()
            points[np.cumsum([len(t) + 1 for t in lower[lo : hi - 1]]) - 1] = _END
            kept = self._mapped(points)
            kept[kept == _END] = 0  # no cleaned text holds that
            out += kept.tobytes().decode("utf-32-le").encode().split(b"\0")
        return out

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(term numbers, -1 where a word is none of the items'; number of words of each text)."""
        if not texts:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        cleaned = [b"" if not t else t.encode().translate(_PLAIN_BLANKS, _PUNCTUATION) if t.isascii() else None for t in texts]
        wide = [i for i, x in enumerate(cleaned) if x is None]
        for i, x in zip(wide, self._wide([texts[i] for i in wide]), strict=True):
            cleaned[i] = x
        # Words with the blank after them lie side by side, as Arrow's strings do; zero bytes end the texts.
        joined = np.frombuffer(b"".join(x + b" \0 " for x in cleaned), np.uint8)
        ends = np.flatnonzero(joined == _BLANK).astype(np.int32) + 1
        starts = np.r_[np.zeros(1, np.int32), ends[:-1]]
        offsets = pa.py_buffer(np.r_[starts[:1], ends])
        words = pa.StringArray.from_buffers(len(ends), offsets, pa.py_buffer(joined))
        found = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False)
        mark = joined[starts] == 0
        real = (ends - starts > 1) & ~mark
        before = np.cumsum(real)[mark]
        return found[real], np.diff(before, prepend=0)


class Items:
    """The benchmark's items as sequences of term numbers."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        self.number: dict[str, int] = {}
        self.ids, self.terms, self.answers = [], [], []
        for item, text in rows:
            found = normal_words(text)
            if found:
                self.ids.append(item)
                self.terms.append([self.number.setdefault(w, len(self.number)) for w in found])
                # The answer: an item's last quarter, three words at least.
                self.answers.append(set(self.terms[-1][-max(3, len(found) // 4) :]))
        self.idf = np.zeros(len(self.number), np.float32)
        self.basis = np.zeros((len(self.number), 1), np.float32)

    def masks(self) -> tuple[np.ndarray, np.ndarray]:
        """The places of each item's terms as bits: (item * number of terms + term, in order; 64 bits), for items of up to 64 words."""
        own: dict[int, int] = {}
        for k, terms in enumerate(self.terms):
            for i, t in enumerate(terms if len(terms) <= 64 else ()):
                at = k * len(self.number) + t
                own[at] = own.get(at, 0) | 1 << i
        keys = np.array(sorted(own), np.int64)
        return keys, np.array([own[x] for x in keys.tolist()], np.uint64)

    @property
    def code(self) -> str:
        return "<i2" if len(self.number) < 1 << 15 else "<i4"


def common_subsequence(terms: list[int], mask: dict[int, int], size: int) -> int:
    """Length of the longest common subsequence with an item, on the bits of an integer."""
    full = (1 << size) - 1
    v = full
    for t in terms:
        if m := mask.get(t):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def common_subsequences(places: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The same for many at once: each row has the bits of its words' places in its item of up to 64 words."""
    full = np.uint64(2**64 - 1) >> (64 - size).astype(np.uint64)
    v = full.copy()
    for k in range(places.shape[1]):
        u = v & places[:, k]
        v = ((v + u) | (v - u)) & full
    return size - np.bitwise_count(v)


def term_rows(rows: DataFrame, items: Items) -> DataFrame:
    """(id, terms binary): the term numbers of all words of a text, -1 where a word is none of the items'."""
    schema = T.StructType([rows.schema["id"], T.StructField("terms", T.BinaryType())])
    shared = rows.sparkSession.sparkContext.broadcast(items)

    def run(batches):
        cut, code = Cutter(shared.value.number), shared.value.code
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in pieces(texts):
                terms, size = cut(texts[lo:hi])
                ends = np.cumsum(np.r_[0, size]) * int(code[-1])
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(terms.astype(code))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), packed.cast(pa.binary())], names=["id", "terms"])

    return written(rows.select("id", "text").mapInArrow(run, schema), "terms")


def unpacked(packed: list[bytes], code: str):
    """(first row, term numbers, number of words of each row) for runs of rows of about STEP words."""
    wide, lo, n = int(code[-1]), 0, 0
    for i, x in enumerate([*packed, None]):
        if x is None or n and n + len(x) // wide > STEP:
            own = packed[lo:i]
            yield lo, np.frombuffer(b"".join(own), code).astype(np.int64), np.array([len(x) // wide for x in own], np.int64)
            lo, n = i, 0
        n += len(x or b"") // wide


class Passages:
    """Windows over the half-window blocks of several texts."""

    def __init__(self, terms: np.ndarray, size: np.ndarray):
        half = WINDOW // 2
        self.ends = np.cumsum(size)
        self.starts = self.ends - size
        doc = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(terms)) - self.starts[doc]
        blocks = -(-size // half)
        self.block_ends = np.cumsum(blocks)
        self.first_block = self.block_ends - blocks
        self.block = self.first_block[doc] + place // half
        self.n_blocks = int(blocks.sum())
        # A window is two neighbouring blocks; the last block of a text also stands alone.
        self.doc = np.repeat(np.arange(len(size)), blocks)
        self.pair = np.arange(self.n_blocks) + 1 < self.block_ends[self.doc]
        self.begin = self.starts[self.doc] + (np.arange(self.n_blocks) - self.first_block[self.doc]) * half

    def sums(self, terms: np.ndarray, rows: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """For each window the weighted sum of its terms' rows."""
        return self.some_sums(terms, rows * weight[:, None], weight > 0)[1]

    def some_sums(self, terms: np.ndarray, rows: np.ndarray, weighs: np.ndarray, every: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(windows, the sums of their terms' rows): of every window, or of those with a term that weighs."""
        used = np.flatnonzero(np.r_[weighs, False][terms])  # -1 is the last
        held, first, n = np.unique(self.block[used], return_index=True, return_counts=True)
        own = np.zeros((len(held) + 1, rows.shape[1]), np.float32)
        for k in range(int(n.max()) if len(n) else 0):  # the blocks' first terms, then the second ones
            at = np.flatnonzero(n > k)
            own[at] += rows[terms[used[first[at] + k]]]
        row = np.full(self.n_blocks + 1, len(held))
        row[held] = np.arange(len(held))
        after = np.where(self.pair, row[1:], len(held))
        row = row[:-1]
        windows = np.arange(self.n_blocks) if every else np.flatnonzero(np.minimum(row, after) < len(held))
        return windows, own[row[windows]] + own[after[windows]]


def _pairs(p: Passages, terms: np.ndarray, weight: np.ndarray, n_terms: int) -> tuple[np.ndarray, np.ndarray]:
    """(first * n_terms + second, number) of the pairs of weighted terms over all windows, first <= second."""
    used = np.nonzero((terms >= 0) & (weight[np.maximum(terms, 0)] > 0))[0] if n_terms else np.empty(0, np.int64)
    t, block = terms[used], p.block[used]
    before = np.r_[False, p.pair[:-1]] if p.n_blocks else p.pair
    code, times = [t * (n_terms + 1)], [1 + before[block]]  # a block lies in its own window and in the one before
    k = 1
    while k < len(t):
        same = block[k:] == block[:-k]
        next_to = (block[k:] == block[:-k] + 1) & p.pair[block[:-k]]
        at = np.nonzero(same | next_to)[0]
        if not len(at):
            break
        x, y = t[at], t[at + k]
        n = np.where(same[at], 1 + before[block[at]], 1)
        code.append(np.minimum(x, y) * n_terms + np.maximum(x, y))
        times.append(np.where(x == y, 2 * n, n))  # both orders of two places of one term
        k += 1
    return _counted(code, times)


def _counted(code: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(np.concatenate(code), return_inverse=True)
    return found, np.bincount(at, weights=np.concatenate(times), minlength=len(found))


def _applied(code: np.ndarray, times: np.ndarray, weight: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """A'A rows, from the counted pairs."""
    n_terms = len(weight)
    x, y = code // n_terms, code % n_terms
    value = (times * weight[x] * weight[y]).astype(np.float32)
    out = np.zeros(rows.shape, np.float32)
    other = np.nonzero(x != y)[0]
    a, b, v = np.r_[x, y[other]], np.r_[y, x[other]], np.r_[value, value[other]]
    order = np.argsort(a, kind="stable")
    a, b, v = a[order], b[order], v[order]
    cuts = np.flatnonzero(np.r_[True, a[1:] != a[:-1], True]).tolist() if len(a) else []
    for lo, hi in zip(cuts, cuts[1:]):  # a term's pairs: one product
        out[a[lo]] = v[lo:hi] @ rows[b[lo:hi]]
    return out


def _item_matrix(items: Items, rows: np.ndarray) -> np.ndarray:
    return np.stack([(rows[t] * items.idf[t, None]).sum(axis=0) for t in items.terms])


def _summed(rows: DataFrame, code: str, n_terms: int, weight, share, shape: tuple[int, int]) -> np.ndarray:
    """The sum over the tasks of one matrix each, that `share` makes of a task's counted pairs."""
    height = max(1, min(FIT_ROWS, shape[0]))

    def run(batches):
        codes, times, held = [np.empty(0, np.int64)], [np.empty(0)], 0
        for batch in batches:
            for _, terms, size in unpacked(batch.column(0).to_pylist(), code):
                own, n = _pairs(Passages(terms, size), terms, weight(), n_terms)
                codes.append(own)
                times.append(n)
                held += len(own)
                if held > 4_000_000:
                    merged = _counted(codes, times)
                    codes, times, held = [merged[0]], [merged[1]], 0
        out = share(*_counted(codes, times))
        cuts = range(0, shape[0], height)
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([lo // height for lo in cuts], pa.int64()), pa.array([task] * len(cuts), pa.int64()), pa.array([out[lo : lo + height].astype(np.float32).tobytes() for lo in cuts], pa.binary())], names=["part", "task", "m"])

    def add(batches):
        # In the order of tasks, whatever order the shares came in.
        part, total = None, None
        for batch in batches:
            for k, m in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own = np.frombuffer(m, np.float32).astype(float)
                if k == part:
                    total += own
                else:
                    if part is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["part", "m"])
                    part, total = k, own
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["part", "m"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.mapInArrow(run, "part long, task long, m binary").repartition(parts, "part").sortWithinPartitions("part", "task")
    out = np.zeros(shape)
    for r in dealt.mapInArrow(add, "part long, m binary").collect():
        own = np.frombuffer(r["m"], float).reshape(-1, shape[1])
        out[r["part"] * height : r["part"] * height + len(own)] = own
    return out


def fit_latent(items: Items, rows: DataFrame, rank: int = RANK) -> np.ndarray:
    """An orthonormal basis (terms x rank) of the passages' latent space; `rows` holds packed terms."""
    n_terms = len(items.number)
    width = min(n_terms, rank + EXTRA)
    omega = np.random.default_rng(7).normal(size=(n_terms, width)).astype(np.float32)
    context = rows.sparkSession.sparkContext
    shared = context.broadcast((items.idf, omega))
    y = _summed(rows, items.code, n_terms, lambda: shared.value[0], lambda *pairs: _applied(*pairs, *shared.value), (n_terms, width))
    own = _item_matrix(items, omega)
    mine = np.zeros_like(y)
    for t, z in zip(items.terms, own, strict=True):
        np.add.at(mine, t, z[None, :] * items.idf[t, None])
    # Items count as much as all passages, so that the space holds them.
    lift = np.linalg.norm(y) / max(np.linalg.norm(mine), 1e-9) if y.any() else 1.0
    q = np.linalg.qr(y + lift * mine)[0].astype(np.float32)
    shared_q = context.broadcast((items.idf, q))
    g = _summed(rows, items.code, n_terms, lambda: shared_q.value[0], lambda *pairs: shared_q.value[1].T @ _applied(*pairs, *shared_q.value), (width, width))
    own = _item_matrix(items, q)
    g += lift * own.T @ own
    values, vectors = np.linalg.eigh((g + g.T) / 2)
    return (q @ vectors[:, np.argsort(-values)[:rank]]).astype(np.float32)


class Finder:
    """Looks for the items in the term numbers of whole texts."""

    #: Candidates checked at once.
    CHUNK = 4096

    def __init__(self, items: Items):
        self.items = items
        self.projected = items.basis * items.idf[:, None]
        latent = _item_matrix(items, items.basis)
        self.latent = (latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)).astype(np.float32)
        self.keys, self.places = items.masks()
        # A few bits of each key tell most that are none.
        self.bits = max(10, (16 * len(self.keys)).bit_length())
        self.maybe = np.zeros(1 << self.bits, bool)
        self.maybe[self._hashed(self.keys)] = True
        self.size = np.array([len(t) for t in items.terms])
        # What the common subsequence must reach; items under SHORT must occur word for word.
        self.least = np.where(self.size < SHORT, self.size, np.ceil(LCS * self.size - 1e-9).astype(np.int64))
        # A rewording may keep the words without weight alone. Where these reach LCS, or the vector is
        # zero, its product with the item says nothing; the item's words are looked for one by one.
        blind = np.array([(items.idf[t] == 0).mean() >= LCS for t in items.terms])
        self.plain = np.nonzero(blind | ~latent.any(axis=1))[0]
        own = sorted({t for k in self.plain.tolist() for t in items.terms[k]})
        self.column = np.full(len(items.number), -1)
        self.column[own] = np.arange(len(own))
        self.words = np.zeros((len(own), len(self.plain)), np.float32)
        for i, k in enumerate(self.plain.tolist()):
            np.add.at(self.words[:, i], self.column[items.terms[k]], 1)
        # So many of a plain item's different words, the most frequent ones, are the fewest that may be enough.
        most = np.cumsum(-np.sort(-self.words, axis=0), axis=0)
        self.fewest = (most < self.least[self.plain] - 0.5).sum(axis=0) + 1

    def _hashed(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, terms: np.ndarray, size: np.ndarray) -> list[tuple[int, int, float, float, float]]:
        """(text number, item number, cosine, shares) of what is found, best passage of each pair."""
        p = Passages(terms, size)
        self.known = np.flatnonzero(terms >= 0)
        found: dict[tuple[int, int], tuple] = {}
        for block, item, cosine in self._candidates(terms, p):
            for lo in range(0, len(block), self.CHUNK):
                part = slice(lo, lo + self.CHUNK)
                self._check(found, terms, p, block[part], item[part], cosine[part])
        return [(d, k, *x) for (d, k), x in sorted(found.items())]

    def _candidates(self, terms: np.ndarray, p: Passages):
        """(blocks, items, cosines): windows near an item in the latent space, and windows with enough words of a plain item."""
        if not p.n_blocks:
            return
        block, v = p.some_sums(terms, self.projected, self.items.idf > 0, every=False)
        length = np.linalg.norm(v, axis=1)
        live = np.flatnonzero(length > 1e-6)
        for at in np.array_split(live, -(-len(live) * len(self.latent) // 4_000_000) or 1):
            cosine = v[at] @ self.latent.T
            cosine /= length[at, None]
            i, k = np.divmod(np.flatnonzero(cosine >= COSINE), len(self.latent))
            yield block[at[i]], k, cosine[i, k]
        if len(self.plain):
            yield from self._plain_candidates(terms, p)

    def _plain_candidates(self, terms: np.ndarray, p: Passages):
        """Counts an item's places whose word lies in a window's surroundings, whatever their order, as if each word were there often enough."""
        width, half = len(self.words), WINDOW // 2
        column = np.r_[self.column, -1][terms]
        used = np.flatnonzero(column >= 0)
        step = max(1, 8_000_000 // max(1, width))
        reach = -(-self.size[self.plain] // half)
        for lo in range(0, p.n_blocks, step):
            # A step's blocks, with as many beside them as any item reaches.
            first, last = max(0, lo - int(reach.max())), min(p.n_blocks, lo + step + 2 + int(reach.max()))
            own = used[slice(*np.searchsorted(p.block[used], [first, last]))]
            held = np.zeros((last - first, width + -width % 64), bool)
            held.reshape(-1)[(p.block[own] - first) * held.shape[1] + column[own]] = True
            held = np.packbits(held, axis=1).view(np.uint64)
            at = np.arange(lo, min(lo + step, p.n_blocks))
            before, after = at - p.first_block[p.doc[at]], p.block_ends[p.doc[at]] - at  # blocks of the text there
            near, done = held[at - first], 0
            for r in np.unique(reach).tolist():
                for shift in (x for x in range(-r, r + 2) if x and not -done <= x <= done + (done > 0)):
                    to = np.flatnonzero(before >= -shift if shift < 0 else after > shift)
                    near[to] |= held[at[to] + shift - first]
                done = r
                group = np.nonzero(reach == r)[0]
                likely = np.flatnonzero(np.bitwise_count(near).sum(axis=1) >= self.fewest[group].min())
                n = np.unpackbits(near[likely].view(np.uint8), axis=1, count=width).astype(np.float32) @ self.words[:, group]
                i, k = np.nonzero(n >= self.least[self.plain[group]] - 0.5)
                yield at[likely[i]], self.plain[group[k]], np.zeros(len(i))

    def _check(self, found, terms, p: Passages, block: np.ndarray, item: np.ndarray, cosine: np.ndarray) -> None:
        """Keep what holds the item: first its words, whatever their order, then the common subsequence, then the answer."""
        n = self.size[item]
        doc = p.doc[block]
        lo = np.maximum(p.starts[doc], p.begin[block] - n)
        hi = np.minimum(p.ends[doc], p.begin[block] + WINDOW + n)
        for i in np.nonzero(n > 64)[0].tolist():
            self._keep(found, terms[lo[i] : hi[i]].tolist(), int(doc[i]), int(item[i]), float(cosine[i]), None)
        some = np.nonzero(n <= 64)[0]
        if not len(some) or not len(self.keys):
            return
        # The surroundings' words that are any item's, side by side.
        a, b = np.searchsorted(self.known, lo[some]), np.searchsorted(self.known, hi[some])
        start = np.cumsum(b - a) - (b - a)
        row = np.repeat(np.arange(len(some)), b - a)
        key = np.repeat(item[some] * len(self.items.number), b - a) + terms[self.known[np.arange(len(row)) + np.repeat(a - start, b - a)]]
        at = np.flatnonzero(self.maybe[self._hashed(key)])
        where = np.minimum(np.searchsorted(self.keys, key[at]), len(self.keys) - 1)
        hit = self.keys[where] == key[at]
        row, places = row[at[hit]], self.places[where[hit]]
        # What is left of each: its words in the item.
        left = np.bincount(row, minlength=len(some))
        begin = np.cumsum(left) - left
        some_left = np.flatnonzero(left)
        covered = np.zeros(len(some), np.uint64)
        if len(some_left):
            covered[some_left] = np.bitwise_or.reduceat(places, begin[some_left])
        enough = np.flatnonzero(np.bitwise_count(covered) >= self.least[item[some]])
        line = np.zeros((len(enough), int(left[enough].max(initial=0))), np.uint64)
        r, c = np.nonzero(np.arange(line.shape[1]) < left[enough, None])
        line[r, c] = places[begin[enough[r]] + c]
        lcs = common_subsequences(line, n[some[enough]])
        for i, x in zip(some[enough].tolist(), lcs.tolist(), strict=True):
            if x >= self.least[item[i]]:
                self._keep(found, terms[lo[i] : hi[i]].tolist(), int(doc[i]), int(item[i]), float(cosine[i]), x)

    def _keep(self, found, part: list[int], doc: int, k: int, cosine: float, length: int | None) -> None:
        own, n = self.items.terms[k], len(self.items.terms[k])
        if length is None:
            mask: dict[int, int] = {}
            for i, t in enumerate(own):
                mask[t] = mask.get(t, 0) | 1 << i
            length = common_subsequence(part, mask, n)
            if length < self.least[k]:
                return
        if n < SHORT:
            if not any(part[i : i + n] == own for i in range(len(part) - n + 1)):
                return
            got = (cosine, 1.0, 1.0)
        else:
            answer = self.items.answers[k]
            got = (cosine, length / n, len(answer.intersection(part)) / len(answer))
            if got[2] < ANSWER:
                return
        found[doc, k] = max(found.get((doc, k), (0.0, 0.0, 0.0)), got, key=lambda x: (x[1], x[2], x[0]))


def _fit(rows: DataFrame, items: Items) -> Items:
    """Weights from all documents, and the latent space; `rows` from term_rows()."""
    n_terms, code = len(items.number), items.code

    def frequencies(batches):
        n, df, step = 0, np.zeros(n_terms, np.int64), max(1, 2_000_000 // n_terms)
        for batch in batches:
            n += batch.num_rows
            for _, terms, size in unpacked(batch.column(0).to_pylist(), code):
                doc = np.repeat(np.arange(len(size)), size)
                known = np.flatnonzero(terms >= 0)
                doc, terms = doc[known], terms[known]
                for d in range(0, len(size), step):
                    held = np.zeros((min(step, len(size) - d), n_terms), bool)
                    lo, hi = np.searchsorted(doc, [d, d + step])
                    held.reshape(-1)[(doc[lo:hi] - d) * n_terms + terms[lo:hi]] = True
                    df += np.bincount(np.flatnonzero(held) % n_terms, minlength=n_terms)
        has = np.nonzero(df)[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, has]), pa.array(np.r_[n, df[has]])], names=["term", "n"])

    # One row for each term of the block's items.
    counts = {r["term"]: r["n"] for r in rows.select("terms").mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n_docs = counts.pop(-1, 0)
    df = np.zeros(n_terms)
    df[list(counts)] = list(counts.values())
    items.idf = np.where(df > max(COMMON * n_docs, 5), 0, np.log((n_docs + 2) / (df + 1))).astype(np.float32)
    items.basis = fit_latent(items, rows.select("terms").coalesce(max(6, -(-n_docs // FIT_DOCS))))
    return items


def contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(id, item, cosine, lcs, answer): every document that holds an item or a rewording of it."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    parts, block = [], []
    for r in benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text")).orderBy("item", "text").toLocalIterator():
        block.append((r["item"], r["text"]))
        if len(block) == block_items:
            parts.append(Items(block))
            block = []
    parts.append(Items(block))
    out = None
    for items in parts:
        if not items.terms:
            continue
        terms = term_rows(rows, items)
        shared = spark.sparkContext.broadcast(_fit(terms, items))

        def find(batches, shared=shared):
            finder, own = Finder(shared.value), shared.value
            names = [id_col, item_col, "cosine", "lcs", "answer"]
            for batch in batches:
                for lo, terms, size in unpacked(batch.column(1).to_pylist(), own.code):
                    if got := finder(terms, size):
                        d, k, *shares = zip(*got, strict=True)
                        ids = batch.column(0).take(pa.array([lo + i for i in d]))
                        yield pa.RecordBatch.from_arrays([ids, pa.array([own.ids[i] for i in k], pa.int64()), *(pa.array(x, pa.float64()) for x in shares)], names=names)

        found = terms.mapInArrow(find, f"{id_col} {kind}, {item_col} long, cosine double, lcs double, answer double")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], f"{id_col} {kind}, {item_col} long, cosine double, lcs double, answer double")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
