"""Byte-level BPE encoding and decoding (operator 5) on length-bucketed padded numpy matrices.

Texts are split by the vocabulary's pattern; a worker keeps a bounded dictionary from piece to its
ids. New pieces of a chunk are encoded together: rows of similar byte length form one padded
matrix, and in each round every row merges its leftmost pair of least rank. Pair ranks come from
an open-addressing hash table; the merged column is compacted away, and finished rows leave.
A piece over 256 bytes is a matrix of one row and merges all occurrences of its least pair at once where
that gives the same ids (else the leftmost one), as one merge a round would take too many rounds.

Results for odd rows: a null or empty text has no ids and decodes to nothing; repeated rows stay
repeated, ids that repeat too (ties have equal results for equal texts); a text of many megabytes, or
one piece of that length, is encoded whole; an empty table gives an empty table; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm.common import map_texts, schema_of, table
from palimpsest.llm.pretokens import Recent, Splitter, kept

NONE = np.int32(2**31 - 1)
#: Widths of the padded matrices; longer pieces are merged one at a time.
WIDTHS = (2, 3, 4, 6, 8, 12, 16, 24, 32, 64, 128, 256)
#: Bytes of a worker's dictionary of pieces.
MEMO_BYTES = 64 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PairTable:
    """(left id, right id) -> id of their concatenation, by multiplicative hashing and linear probing."""

    MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, ranks: dict[bytes, int]):
        pairs = [(ranks[t[:k]] << 32 | ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        keys, values = np.array([k for k, _ in pairs], np.uint64), np.array([v for _, v in pairs], np.int32)
        bits = max(4, int(len(pairs) * 4 - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        self.keys = np.full(1 << bits, np.uint64(2**64 - 1))
        self.values = np.full(1 << bits, NONE)
        at, todo, self.probes = self._slot(keys), np.arange(len(keys)), 1
        while len(todo):
            free = self.keys[at[todo]] == np.uint64(2**64 - 1)
            self.keys[at[todo[free]]] = keys[todo[free]]  # of several for one slot the last one stays
            placed = self.keys[at[todo]] == keys[todo]
            self.values[at[todo[placed]]] = values[todo[placed]]
            todo = todo[~placed]
            at[todo] = (at[todo] + np.uint64(1)) & self.mask
            self.probes += len(todo) > 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * self.MULTIPLIER) >> self.shift

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs; NONE where the concatenation is no token or a side is padding (-1)."""
        keys = (left.astype(np.int64) << 32 | right.astype(np.int64) & 0xFFFFFFFF).astype(np.uint64)
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], NONE)
        open_ = (found != keys) & (found != np.uint64(2**64 - 1))
        for _ in range(self.probes - 1):
            if not open_.any():
                break
            where = np.nonzero(open_)
            at[where] = (at[where] + np.uint64(1)) & self.mask
            found = self.keys[at[where]]
            hit = found == keys[where]
            out[where] = np.where(hit, self.values[at[where]], NONE)
            open_[where] = ~hit & (found != np.uint64(2**64 - 1))
        out[(left < 0) | (right < 0)] = NONE
        return out


class ByteBpe:
    """Encoder and decoder for a vocabulary of byte strings with ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.pairs = PairTable(ranks)
        self.of_byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        if (self.of_byte < 0).any():
            raise ValueError("the vocabulary lacks some single bytes")
        tokens = sorted(ranks.items(), key=lambda x: x[1])
        self.size = np.zeros(tokens[-1][1] + 1, np.int64)
        self.start = np.zeros(tokens[-1][1] + 1, np.int64)
        self.flat = np.frombuffer(b"".join(t for t, _ in tokens), np.uint8)
        ids, sizes = np.array([r for _, r in tokens]), np.array([len(t) for t, _ in tokens])
        self.size[ids], self.start[ids] = sizes, np.cumsum(sizes) - sizes

    def encode_pieces(self, new: list[bytes]) -> list[bytes]:
        """For each piece its ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(new)
        todo: dict[int, list[int]] = {}
        for i, piece in enumerate(new):
            if (rank := self.ranks.get(piece)) is not None:
                out[i] = rank.to_bytes(4, "little")
            elif piece:
                width = next((w for w in WIDTHS if len(piece) <= w), 0)
                todo.setdefault(width, []).append(i)
        for width, rows in todo.items():
            if not width:
                for i in rows:
                    out[i] = self._encode_long(new[i])
                continue
            step = max(1, (1 << 20) // width)
            for lo in range(0, len(rows), step):
                self._encode_matrix([new[i] for i in rows[lo : lo + step]], rows[lo : lo + step], width, out)
        return out

    def _encode_matrix(self, part: list[bytes], rows: list[int], width: int, out: list[bytes]) -> None:
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in part), np.uint8).reshape(-1, width)
        size, which = np.array([len(p) for p in part]), np.array(rows)
        ids = np.where(np.arange(width) < size[:, None], self.of_byte[raw], np.int32(-1))
        rank = self.pairs(ids[:, :-1], ids[:, 1:])
        while len(ids):
            at = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(ids), np.int64)
            best = rank[np.arange(len(ids)), at] if rank.shape[1] else np.full(len(ids), NONE)
            if (done := best == NONE).any():
                for i, n, row in zip(which[done].tolist(), size[done].tolist(), ids[done].astype("<u4"), strict=True):
                    out[i] = row[:n].tobytes()
                go = ~done
                ids, rank, size, which, at, best = ids[go], rank[go], size[go], which[go], at[go], best[go]
                if not len(ids):
                    return
            each = np.arange(len(ids))
            ids[each, at] = best
            # Each row loses one id (the right one of its pair) and one pair, so the rest stays rectangular.
            keep = np.ones(ids.shape, bool)
            keep[each, at + 1] = False
            ids = ids[keep].reshape(len(ids), -1)
            keep = np.ones(rank.shape, bool)
            keep[each, at] = False
            rank = rank[keep].reshape(len(rank), -1)
            size = size - 1
            left, right = np.nonzero(at > 0)[0], np.nonzero(at < rank.shape[1])[0]
            rank[left, at[left] - 1] = self.pairs(ids[left, at[left] - 1], ids[left, at[left]])
            rank[right, at[right]] = self.pairs(ids[right, at[right]], ids[right, at[right] + 1])

    def _encode_long(self, piece: bytes) -> bytes:
        """One long piece: all occurrences of the least pair at once.

        That equals leftmost-first merging as long as no merge makes a pair of lower rank; where
        one would, only the leftmost occurrence is merged.
        """
        ids = self.of_byte[np.frombuffer(piece, np.uint8)]
        while len(ids) > 1:
            rank = self.pairs(ids[:-1], ids[1:])
            least = rank.min()
            if least == NONE:
                break
            at = np.nonzero(rank == least)[0]
            # In a run of adjacent occurrences every other one is merged, from the left.
            first = np.r_[True, np.diff(at) > 1]
            at = at[(np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))) % 2 == 0]
            for chosen in (at, at[:1]):
                merged = ids.copy()
                merged[chosen] = least
                made = np.zeros(len(ids), bool)
                made[chosen] = True
                keep = np.ones(len(ids), bool)
                keep[chosen + 1] = False
                merged, made = merged[keep], made[keep]
                near = np.nonzero(made[:-1] | made[1:])[0]
                if len(chosen) == 1 or not len(near) or self.pairs(merged[near], merged[near + 1]).min() > least:
                    break
            ids = merged
        return ids.astype("<u4").tobytes()

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids in a row, and the number of bytes of each id."""
        size = self.size[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.start[ids] - ends + size, size) + np.arange(total)], size


def _encoder(vocabulary: str, pattern: str, memo_bytes: int):
    bpe, split, memo = kept(("bpe", vocabulary, pattern, memo_bytes), lambda: _coder(vocabulary, pattern, memo_bytes))

    def encode(texts: list[str | None]) -> list[bytes]:
        found = [split(t) if t else [] for t in texts]
        get = memo.hold(set().union(*found)).__getitem__
        return [b"".join(map(get, x)) for x in found]

    return bpe, encode


def _coder(vocabulary: str, pattern: str, memo_bytes: int):
    bpe = ByteBpe(read_ranks(vocabulary))
    return bpe, Splitter(pattern), Recent(lambda new: bpe.encode_pieces([p.encode() for p in new]), memo_bytes)


def encode(docs: DataFrame, vocabulary: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", memo_bytes: int = MEMO_BYTES) -> DataFrame:
    """(id, ids array<int>) of every whole text, without special tokens."""

    def make():
        _, run = _encoder(vocabulary, pattern, memo_bytes)

        def work(texts):
            import pyarrow as pa

            packed = run(texts)
            ends = np.cumsum([0, *(len(x) // 4 for x in packed)]).astype(np.int32)
            return [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<i4")))]

        return work

    return map_texts(docs, make, schema_of("ids array<int>"), [id_col], text_col)


def decode(encoded: DataFrame, vocabulary: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, data binary, text string) of id arrays; `text` has U+FFFD where ids are no whole UTF-8. Null ids give nulls."""
    names = [id_col, "data", "text"]

    def run(batches):
        import pyarrow as pa

        bpe = ByteBpe(read_ranks(vocabulary))
        for batch in batches:
            data = [None if x is None else bpe.decode(np.array(x, np.int64))[0].tobytes() for x in batch.column(1).to_pylist()]
            text = [None if x is None else x.decode("utf-8", "replace") for x in data]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary()), pa.array(text, pa.string())], names=names)

    schema = schema_of("data binary, text string")
    schema.fields.insert(0, encoded.schema[id_col])
    schema.names.insert(0, id_col)
    return encoded.select(id_col, ids_col).mapInArrow(run, schema)


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", memo_bytes: int = MEMO_BYTES) -> DataFrame:
    """Encode every whole text, decode the ids, and give digests of both: n_tokens, ids_sha256, decoded_sha256."""

    def make():
        bpe, run = _encoder(vocabulary, pattern, memo_bytes)

        def work(texts):
            packed = run(texts)
            data, size = bpe.decode(np.frombuffer(b"".join(packed), "<u4"))
            n = np.array([len(x) // 4 for x in packed], np.int64)
            upto = np.r_[0, np.cumsum(size)][np.r_[0, np.cumsum(n)]]
            back = [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(upto[:-1], upto[1:], strict=True)]
            return [n, [hashlib.sha256(x).hexdigest() for x in packed], back]

        return work

    return map_texts(docs, make, schema_of("n_tokens long, ids_sha256 string, decoded_sha256 string"), [id_col], text_col)


def vocabulary_of(name: str) -> tuple[str, str]:
    import public_tokenizers as P

    return P.path(name), P.PATTERN


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), *vocabulary_of("byte_bpe_50k.tiktoken"))
