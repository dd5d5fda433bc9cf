"""A corpus pipeline: toxicity, line dedup, near-duplicate removal, decontamination, tokenisation.

Each stage takes what its predecessor kept, as written Parquet, and its decisions take effect:
toxic documents go, later copies of repeated runs of lines are cut (and documents of which
nothing is left go), one document of each group of near copies stays, documents that hold a window
of a benchmark item go, and what is left is encoded.

Defined results: a null text counts as empty; it is not toxic, repeats no run of lines and holds
no window, and all empty texts are copies of one another, as are all texts without words.  Rows
that repeat an id are documents of their own, so each stays unless a stage's rule takes it.
Equal rows are copies, of which one stays.  Of equal similarities nothing hangs on an order but
that the least id of a group stays.  An empty table gives an empty table after every stage.
Other columns stay as they are, whatever their names, until the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attestra.llm import bpe, decontaminate, line_dedup, near_copies, storage, toxicity
from attestra.llm.queries import vocabulary_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    storage.release(spark)  # what earlier stages held is not needed once their results are written
    return toxicity.without_toxic(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    storage.release(spark)  # what earlier stages held is not needed once their results are written
    return line_dedup.without_emptied(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    storage.release(spark)  # what earlier stages held is not needed once their results are written
    return near_copies.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    storage.release(spark)  # what earlier stages held is not needed once their results are written
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    storage.release(spark)  # what earlier stages held is not needed once their results are written
    return bpe.digests(docs, vocabulary_path(), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe_encoding", tokenize),
]

#: SimHash, segment scores and BPE have no SQL; the tests hold the result against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written as Parquet and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs, path = storage.written(stage(spark, docs, sf_dir), name, keep=True)
        if before is not None:
            storage.drop(spark, before)
        before = path
    return docs
