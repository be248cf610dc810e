"""A training corpus from the table documents: each stage reads what its predecessor wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, linededup, packing, simhash, toxicity
from lodestone.llm.common import source, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model finds toxic go.  It is fitted to the labelled rows of the table documents."""
    model = toxicity.train(source(spark, sf_dir, "documents"), source(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in 10 documents or more stay in the first of them (the smallest doc_id) and go elsewhere."""
    names = docs.columns
    kept = linededup.cut(docs, linededup.build_runs(docs.select("doc_id", "text")), keep_first=True)
    n_chars = F.when(F.col("__n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", n_chars.cast(docs.schema["n_chars"].dataType)).select(*names)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8 or more."""
    return simhash.keep_one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go."""
    return decontaminate.drop_contaminated(docs, source(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document, with its bucket and batch."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", simhash_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: A fitted model and fingerprints by XXH64 have no SQL.  Tests hold line dedup, near dedup and decontamination against brute
#: force, packing against its own rules and toxicity against held-out labels; the pipeline as a whole by columns and counts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = source(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = table(docs, f"stage-{name}")
    return docs
