"""The corpus pipeline: quality classifier, line dedup, SimHash near-dedup, benchmark
decontamination, byte-level BPE.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but
the last return the columns of ``documents``.  ``run`` writes the rows between stages to the
shared checkpoint folder, so a lost executor costs at most one stage's tasks, and deletes them
once the next stage's rows are written.

Defined results: null and empty texts go through every stage; rows that share an id, or have none,
are judged each by its own text, but for near-dedup, where the rows of an id stay or go together
(see ``simhash.keep_one``); repeated rows are copies there; an empty table gives an empty result;
further columns of the input are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rillmark.llm import byte_bpe, decontamination, line_windows, quality, simhash
from rillmark.llm.common import discard, stored_at


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a calibrated quality below one half go."""
    return quality.keep_good(spark, docs, sf_dir)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows are cut out of the texts; no document goes."""
    cut = line_windows.dedup_lines(docs)
    return cut.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of every near-duplicate component stays."""
    return simhash.keep_one(docs, simhash.near_duplicates(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold any window of a benchmark item go."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes what is left, decodes it again, and returns counts and digests."""
    return byte_bpe.production(docs)


STAGES = [
    ("quality_classifier", quality_filter),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("byte_bpe", tokens),
]

#: A fitted classifier and byte-level BPE have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs, path = stored_at(stage(spark, docs, sf_dir))
        if before:
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
