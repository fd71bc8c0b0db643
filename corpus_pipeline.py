"""A corpus pipeline of five stages: quality, language, near-duplicates, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's documents. All but the last return the columns of documents.

Results for odd rows: null and empty texts have their defined results in the operators (the
language stage drops them: they have no letter); rows without an id are judged like others and
always stay in the near-duplicate stage; of repeated rows and ties one stays there, that of the least
id; texts of many megabytes are handled whole; an empty table passes through as one; extra columns
are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import byte_bpe, decontaminate, language_id, quality, simhash
from palimpsest.llm.common import last_written, scratch, table, written

#: Fingerprints of at most so many different bits are tested for similar shingles.
WIDE_BITS = 11
#: A document goes when no language's profile comes nearer than this, or it has no letter.
LEAST_LANGUAGE = 0.2


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier (operator 4) rejects."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~language_id.held_out("doc_id", 3, 1))
    scored = quality.score(docs, model, keep=docs.columns, prefix="__quality_")
    return scored.where(F.col("__quality_predicted") == 1).select(docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of no known language (operator 6); what is named fills a language that was missing."""
    profiles = language_id.fit_profiles(docs, ~language_id.held_out("doc_id", 4, 2))
    named = language_id.identify(docs, profiles, keep=docs.columns, prefix="__language_")
    known = (F.col("__language_lang_pred") != language_id.UNKNOWN) & (F.col("__language_score") >= LEAST_LANGUAGE)
    lang = F.coalesce("lang", "__language_lang_pred").alias("lang")
    return named.where(known).select(*(lang if c == "lang" else F.col(c) for c in docs.columns))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each SimHash component (operator 10), with similar texts of wider distance linked too."""
    return simhash.deduplicated(docs, wide=WIDE_BITS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark passage (operator 8)."""
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode and decode what is left (operator 5)."""
    return byte_bpe.round_trip(docs, *byte_bpe.vocabulary_of("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("byte-level BPE encoding and decoding", tokens_stage),
]

#: Classifiers, hashes and merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents; what a stage wrote on the way is deleted once its result is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch(spark) as drop:
            docs = written(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
            if before:
                drop(before)
        before = last_written()
    return docs
