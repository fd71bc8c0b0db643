"""Language identification (operator 6) by rank-order n-gram profiles and out-of-place distance.

A profile is the `TOP` most frequent n-grams (1 to 3 letters, words padded by a blank) of a
language. A document's own `TOP` n-grams are ranked the same way; each adds the difference of
its ranks, or TOP where the profile lacks it, and the language of least distance wins.

Profiles are fitted on a bounded sample: about `per_language` whole documents a language, chosen
by a hash of the id. Everything else covers all rows in one pass without a shuffle: each chunk of
texts is turned into one array of (document, n-gram) keys, sorted, and counted by numpy.

Results for odd rows: a text that is null or has no letter gives `und` with score 0; rows with a
null language are scored and not learned from; rows without an id are scored, not held out and
not learned from; ties go to the language first in code-point order and to the smaller n-gram;
if nothing can be learned, every row is `und`; repeated rows and ids stay repeated; a text of many
megabytes is counted whole (ranks tell counts apart up to 4,194,303, beyond that ties go by code), and
a single long word is one word; letters beyond the basic plane share 6,400 codes of the private-use
area, so some of them are counted as one; an empty table gives an empty table; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.llm.common import map_texts, schema_of, table

TOP = 300
PER_LANGUAGE = 2000
MAX_LANGUAGES = 4096
UNKNOWN = "und"
_BLANK = 1


@functools.cache
def _letters() -> np.ndarray:
    """Code unit of the basic plane -> its lower-case letter, or a blank."""
    table = np.full(1 << 16, _BLANK, np.uint16)
    for i in range(2, 1 << 16):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else i
    return table


def _fold(cp: np.ndarray) -> np.ndarray:
    out = _letters()[np.minimum(cp, 0xFFFF)]
    high = np.nonzero(cp > 0xFFFF)[0]
    if len(high):
        # Letters beyond the basic plane share the private-use area.
        values, back = np.unique(cp[high], return_inverse=True)
        to = np.array([0xE000 + ord(chr(v).lower()[0]) % 0x1900 if chr(v).isalpha() else _BLANK for v in values.tolist()], np.uint16)
        out[high] = to[back]
    return out


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, n-gram code, count) of whole texts, ordered by row and code; at most 2**15 texts."""
    raw = "\0".join(t or "" for t in texts) + "\0"
    cp = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), "<u4")
    row = np.repeat(np.arange(len(texts), dtype=np.uint64), [len(t or "") + 1 for t in texts])
    c = _fold(cp)
    keep = np.r_[True, (c[1:] != _BLANK) | (c[:-1] != _BLANK)]
    c = np.r_[np.uint64(_BLANK), c[keep].astype(np.uint64)]
    row = np.r_[np.uint64(0), row[keep]] << np.uint64(48)
    s = np.uint64(16)
    letter = c != _BLANK
    one = (row | c)[letter]
    pair = letter[:-1] | letter[1:]
    two = (np.where(letter[:-1], row[:-1], row[1:]) | c[:-1] << s | c[1:])[pair]
    middle = letter[1:-1]
    three = (row[1:-1] | (c[:-2] << s | c[1:-1]) << s | c[2:])[middle]
    key = np.concatenate([one, two, three]).view(np.int64)
    key.sort()
    if not len(key):
        return (np.empty(0, np.int64),) * 3
    first = np.r_[0, np.nonzero(np.diff(key))[0] + 1]
    return key[first] >> 48, key[first] & ((1 << 48) - 1), np.diff(np.r_[first, len(key)])


def ranked(row: np.ndarray, code: np.ndarray, count: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, rank) of each row's `top` n-grams: by count, then by code."""
    if not len(row):
        return row, code, count
    starts = np.r_[0, np.nonzero(np.diff(row))[0] + 1]
    start_of = np.repeat(starts, np.diff(np.r_[starts, len(row)]))
    local, most = np.arange(len(row)) - start_of, (1 << 22) - 1
    order = row << 48 | (most - np.minimum(count, most)) << 26 | local
    order.sort()
    got = (order >> 48, start_of + (order & ((1 << 26) - 1)), local)
    keep = local < top
    return got[0][keep], code[got[1][keep]], got[2][keep]


class Profiles:
    """Ranks of the languages' n-grams, as one table over the union of their n-grams."""

    def __init__(self, of: dict[str, list[int]], top: int = TOP):
        self.languages, self.top = sorted(of), top
        self.codes = np.unique(np.array([c for x in of.values() for c in x], np.int64))
        self.ranks = np.full((len(self.codes), len(of)), -1, np.int32)
        for k, name in enumerate(self.languages):
            self.ranks[np.searchsorted(self.codes, np.array(of[name], np.int64)), k] = np.arange(len(of[name]))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return names, score
        for lo in range(0, len(texts), 1 << 14):
            row, code, rank = ranked(*ngrams(texts[lo : lo + (1 << 14)]), self.top)
            if not len(row):
                continue
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            place = self.ranks[at]
            away = np.where((place < 0) | (self.codes[at] != code)[:, None], self.top, np.abs(place - rank[:, None]))
            starts = np.r_[0, np.nonzero(np.diff(row))[0] + 1]
            total = np.add.reduceat(away, starts, axis=0, dtype=np.int64)
            size = np.diff(np.r_[starts, len(row)])
            best = total.argmin(axis=1)
            for i, b in zip((row[starts] + lo).tolist(), best.tolist(), strict=True):
                names[i] = self.languages[b]
            score[row[starts] + lo] = np.clip(1 - total[np.arange(len(best)), best] / (self.top * size), 0, 1)
        return names, score


def held_out(id_col: str, parts: int, which: int) -> Column:
    """Whether a row is kept from learning: crc32 of the id as text, modulo `parts`."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == which, F.lit(False))


def fit_profiles(docs: DataFrame, learn: Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", top: int = TOP, per_language: int = PER_LANGUAGE) -> Profiles:
    """Profiles from about `per_language` of the rows of each language for which `learn` holds."""
    rows = docs.where(learn & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    rates = rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(rates) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not rates:
        return Profiles({}, top)
    # The languages are few, by the check above, so their rates are literals.
    rate = F.create_map(*(F.lit(x) for r in rates for x in (r["lang"], min(1.0, per_language / r["count"]))))
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003 < rate[F.col("lang")])

    def count(batches):
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), object)
            for name in sorted(set(langs)):
                own = [texts[i] for i in np.nonzero(langs == name)[0]]
                joined, chars = [], 0
                for i, t in enumerate(own):
                    joined.append(t)
                    chars += len(t)
                    if chars > 1 << 20 or i == len(own) - 1:
                        _, code, n = ngrams(["\0".join(joined)])
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(code)), pa.array(code), pa.array(n, pa.int64())], names=["lang", "code", "n"])
                        joined, chars = [], 0

    counts = sample.select("text", "lang").mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    of: dict[str, list[int]] = {r["lang"]: [] for r in rates}
    for r in counts.withColumn("place", place).where(F.col("place") <= top).orderBy("lang", "place").collect():
        of[r["lang"]].append(r["code"])
    return Profiles({k: v for k, v in of.items() if v}, top)


def identify(docs: DataFrame, profiles: Profiles, *, keep: list[str], text_col: str = "text", prefix: str = "") -> DataFrame:
    """The kept columns with `lang_pred` and `score` (names get the prefix)."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)  # at most TOP n-grams a language

    def make():
        return lambda texts: list(shared.value.predict(texts))

    return map_texts(docs, make, schema_of(f"{prefix}lang_pred string, {prefix}score double"), keep, text_col)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = held_out("doc_id", 4, 2)
    profiles = fit_profiles(docs, ~out)
    return identify(docs, profiles, keep=["doc_id"]).select("doc_id", out.alias("held_out"), "lang_pred", "score")
