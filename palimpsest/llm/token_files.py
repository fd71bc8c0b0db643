"""Token-ID files (operator 7): a concatenated id array with Elias-Fano document boundaries.

One file holds a run of documents in ascending id order:

    magic "PTOK2\\n", header length (u32), header (JSON), ids, boundaries, document ids

The ids are little-endian unsigned integers of 16 bits where the vocabulary allows, else 32.
Boundaries (offsets of the documents' ends within the file) and document ids are Elias-Fano
sequences; offsets are read by their select structures. The header holds the numbers of documents
and ids. Files are named by range and number, so that their names sort as their documents do.

Writing needs one shuffle, of the encoded ids: a first pass over the id column alone finds range
borders, then texts are encoded where they are read and go to their range packed. Ids that repeat,
or are missing, in many rows fill several ranges, split by a hash of the text, so no task gets all
of them. A writer task holds one file's ids; files are written under a temporary name and renamed,
and a task that runs twice leaves the same file. Reading goes through Spark's binaryFile source;
the start of a file comes from the headers of the files before it, summed by range first.

A worker's dictionary is bounded in bytes and dropped before the writing stage.

Results for odd rows: a null or empty text is a document of the end id alone; null document ids
come first; documents with equal ids (ties) follow each other by a hash of the text, then by their
ids' bytes, so repeated rows are neighbours; a text of many megabytes, or one word of that length,
is one document like any other; an empty table leaves no file and gives no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import json
import struct
import zlib
from array import array
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.llm.common import fresh_path, pieces, table, written
from palimpsest.llm.elias_fano import EliasFano
from palimpsest.llm.pretokens import forget, kept, lower_words, word_pieces

MAGIC = b"PTOK2\n"
#: Ids in one file: it is closed after the document that reaches them.
IDS_PER_FILE = 1 << 22
#: Bytes of a worker's dictionary of words and pieces.
MEMO_BYTES = 160 << 20
#: Documents handed on at once by the reader.
ROWS = 1 << 14
_COUNT = struct.Struct("<I")


def pack_file(packed: list[bytes], doc_ids: list[int | None], width: int) -> list[bytes]:
    """The parts of one file of documents given as packed ids, in order; null document ids first."""
    nulls = sum(x is None for x in doc_ids)
    ends = np.cumsum([len(x) // width for x in packed])
    known = np.array([x for x in doc_ids if x is not None], np.int64)
    tails = [EliasFano.build(ends).to_bytes(), EliasFano.build(known).to_bytes()]
    n = int(ends[-1]) if len(ends) else 0
    head = json.dumps({"width": width, "docs": len(packed), "nulls": nulls, "ids": n, "bytes": [n * width, *map(len, tails)]}).encode()
    return [MAGIC, _COUNT.pack(len(head)), head, *packed, *tails]


class TokenFile:
    """Random access to a file's documents: ids(i) reads two boundaries by select."""

    def __init__(self, data):
        data = memoryview(data)
        if bytes(data[: len(MAGIC)]) != MAGIC:
            raise ValueError("not a token file")
        (n,) = _COUNT.unpack_from(data, len(MAGIC))
        at = len(MAGIC) + _COUNT.size
        self.head = json.loads(bytes(data[at : at + n]))
        a, b, c = self.head["bytes"]
        at += n
        self._ids = np.frombuffer(data, f"<u{self.head['width']}", self.head["ids"], at)
        self.ends = EliasFano.from_bytes(data[at + a : at + a + b])
        self._known = EliasFano.from_bytes(data[at + a + b : at + a + b + c])

    def __len__(self) -> int:
        return self.head["docs"]

    def ids(self, i: int) -> np.ndarray:
        return self._ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]

    def doc_ids(self) -> list[int | None]:
        return [None] * self.head["nulls"] + self._known.values().tolist()

    def documents(self):
        """(document id, start within the file, ids) in order."""
        lo = 0
        for i, doc_id in enumerate(self.doc_ids()):
            hi = self.ends.select(i)
            yield doc_id, lo, self._ids[lo:hi]
            lo = hi


def read_header(stream) -> dict:
    """The header of an open file; reads no further."""
    start = stream.read(len(MAGIC) + _COUNT.size)
    if start[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token file")
    return json.loads(stream.read(*_COUNT.unpack_from(start, len(MAGIC))))


def _ids_of_words(vocabulary: str, end_id: int, memo_bytes: int):
    """(number format, dictionary from a white-space word to its packed ids)."""
    from tokenizers import Tokenizer

    short = max(Tokenizer.from_file(vocabulary).get_vocab_size(with_added_tokens=True) - 1, end_id) < 1 << 16
    code = "H" if short else "I"
    return "<u2" if short else "<u4", word_pieces(vocabulary, lambda ids: array(code, ids).tobytes(), b"".join, memo_bytes).words


def range_borders(docs: DataFrame, id_col: str, parts: int) -> tuple[list[int], int]:
    """Document ids that split the rows into about equal ranges, and the ranges for rows without an id.

    An id comes as often as it fills a range. Reads the id column only.
    """
    own = F.col(id_col).cast("long")
    shares = [i / parts for i in range(1, parts)] or [0.5]
    found = docs.agg(F.percentile_approx(own, shares, 20 * parts).alias("q"), F.count("*").alias("n"), F.count(own).alias("known")).first()
    blank = -(-(found["n"] - found["known"]) * parts // max(found["n"], 1))
    return (found["q"] or []) if parts > 1 else [], blank


def ranges(ids: pa.Array, digest: np.ndarray, borders: np.ndarray, blank: int) -> np.ndarray:
    """The range of each row: by id; the rows of an id that fills several, and those without an id, by a hash of the text."""
    share = (digest >> np.int64(11)).astype(np.float64) / 2.0**53 + 0.5
    known = ids.fill_null(0).to_numpy(zero_copy_only=False)
    first = np.searchsorted(borders, known, "left")
    span = np.maximum(np.searchsorted(borders, known, "right") - first, 1)
    missing = ids.is_null().to_numpy(zero_copy_only=False)
    first, span = np.where(missing, 0, first + blank), np.where(missing, max(blank, 1), span)
    return (first + np.minimum((share * span).astype(np.int64), span - 1)).astype(np.int32)


def write_token_files(docs: DataFrame, vocabulary: str, path: str, *, end_id: int, id_col: str = "doc_id", text_col: str = "text", ids_per_file: int = IDS_PER_FILE, memo_bytes: int = MEMO_BYTES) -> DataFrame:
    """Encode whole texts with a tokenizers file and write them to `path`, a folder that all executors reach.

    Returns the manifest: file, n_docs, n_ids, in a table of its own. No special tokens are added
    but `end_id` after each document.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found, blank = range_borders(docs, id_col, parts)
    borders = np.array(found, np.int64)

    def encode(batches):
        kind, memo = kept(("ids", vocabulary, end_id, memo_bytes), lambda: _ids_of_words(vocabulary, end_id, memo_bytes))
        end = np.array([end_id], kind).tobytes()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            part = ranges(batch.column(0), batch.column(2).to_numpy(), borders, blank)
            for lo, hi in pieces(texts):
                split = [lower_words(t) if t else [] for t in texts[lo:hi]]
                get = memo.hold(set().union(*split)).__getitem__
                packed = pa.array([b"".join(map(get, x)) + end for x in split], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), packed, pa.array(np.full(hi - lo, int(kind[-1]), np.int32)), pa.array(part[lo:hi])], names=["id", "digest", "packed", "width", "range"])

    text = F.col(text_col)
    key = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("digest"))
    encoded = key.mapInArrow(encode, "id long, digest long, packed binary, width int, range int")
    dealt = encoded.repartitionById(len(borders) + blank + 1, "range").sortWithinPartitions(F.col("range"), F.col("id").asc_nulls_first(), "digest", "packed")

    def write(batches):
        from pyarrow import fs

        forget()
        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        held, ids, size, number, current, width = [], [], 0, 0, None, 2

        def close():
            name = f"{current:08d}-{number:06d}.ptok"
            temporary = f"{folder}/.{name}.{np.random.default_rng().integers(1 << 62):x}"
            with store.open_output_stream(temporary) as out:
                for part in pack_file(held, ids, width):
                    out.write(part)
            put(store, temporary, f"{folder}/{name}")
            return pa.RecordBatch.from_pydict({"file": [name], "n_docs": [len(held)], "n_ids": [size // width]}, schema=pa.schema([("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

        for batch in batches:
            for doc_id, packed, w, part in zip(batch.column(0), batch.column(1), batch.column(2), batch.column(3), strict=True):
                part = part.as_py()
                if held and (part != current or size // width >= ids_per_file):
                    yield close()
                    number = number + 1 if part == current else 0
                    held, ids, size = [], [], 0
                elif part != current:
                    number = 0
                current, width = part, w.as_py()
                held.append(packed.as_py())
                ids.append(doc_id.as_py())
                size += len(held[-1])
        if held:
            yield close()

    return written(dealt.select("id", "packed", "width", "range").mapInArrow(write, "file string, n_docs long, n_ids long"), "token-manifest")


def put(store, temporary: str, name: str) -> None:
    """Rename a finished file. Another attempt of the task may have left the same file: then that stands."""
    from pyarrow import fs

    if store.get_file_info(name).type == fs.FileType.NotFound:
        try:
            store.move(temporary, name)
        except OSError:
            if store.get_file_info(name).type == fs.FileType.NotFound:
                raise
    if store.get_file_info(temporary).type != fs.FileType.NotFound:
        store.delete_file(temporary)


def file_starts(files: DataFrame) -> DataFrame:
    """(file, before): the ids in the files before, from (file, n_ids) rows: summed by range, then within each range."""
    own = files.withColumn("range", F.substring("file", 1, 8).cast("int"))
    # One row a range; there are as many as partitions of the writer's shuffle.
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = own.groupBy("range").agg(F.sum("n_ids").alias("n")).select("range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("range").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return own.withColumn("inner", F.coalesce(F.sum("n_ids").over(within), F.lit(0))).join(totals, "range").select("file", (F.col("base") + F.col("inner")).alias("before"))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row a document, from the files alone: doc_id, start, n_tokens, ids_crc32."""
    names = ["file", "doc_id", "local", "n_tokens", "ids_crc32"]

    def heads(batches):
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(path)
        for batch in batches:
            found = [x.rpartition("/")[2] for x in batch.column(0).to_pylist()]
            n = []
            for name in found:
                with store.open_input_stream(f"{folder}/{name}") as f:
                    n.append(read_header(f)["ids"])
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(n, pa.int64())], names=["file", "n_ids"])

    def read(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = ((d, lo, len(x), zlib.crc32(x.astype("<u4").tobytes())) for d, lo, x in TokenFile(data.as_buffer()).documents())
                while rows := list(islice(found, ROWS)):
                    cols = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name.rpartition("/")[2]] * len(rows)), *(pa.array(c, pa.int64()) for c in cols)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ptok").load(path)
    docs = files.select("path", "content").mapInArrow(read, "file string, doc_id long, local long, n_tokens long, ids_crc32 long")
    starts = file_starts(files.select("path").mapInArrow(heads, "file string, n_ids long"))
    return docs.join(starts, "file").select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    path = fresh_path(spark, "token-files")
    manifest = write_token_files(table(spark, sf_dir, "documents"), P.path("word_bpe_49k.json"), path, end_id=1)
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_token_files(spark, path)
