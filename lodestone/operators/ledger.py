"""Folds over provenance records.

Records: (entry_id, record_type, block, blocks, derived_from, supersedes, producer struct<kind,id,version>, locator).
"Last" is the largest entry_id, never the latest time.  Every fold is a pre-aggregated group-by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def of_type(records: DataFrame, kind: str) -> DataFrame:
    return records.where(F.col("record_type") == kind)


def _last(value: Column) -> Column:
    return F.max_by(value, "entry_id")


def locators(records: DataFrame) -> DataFrame:
    rows = of_type(records, "derivation").where(F.col("locator").isNotNull())
    return rows.groupBy(F.col("block").alias("block_id")).agg(_last(F.col("locator")).alias("locator"))


def derivations(records: DataFrame) -> DataFrame:
    """(block_id, derived_from, producer, entry_id) of each block's last derivation."""
    rows = of_type(records, "derivation").groupBy(F.col("block").alias("block_id"))
    last = rows.agg(_last(F.struct("derived_from", "producer", F.col("entry_id").alias("record_id"))).alias("d"))
    return last.select("block_id", "d.derived_from", "d.producer", F.col("d.record_id").alias("entry_id"))


def citations(records: DataFrame) -> DataFrame:
    """Edges (cited, dependent) of all derivations, not only the last."""
    rows = of_type(records, "derivation").select(F.explode("derived_from").alias("cited"), F.col("block").alias("dependent"))
    return rows.distinct()


def superseded_by(records: DataFrame) -> DataFrame:
    rows = of_type(records, "supersession").groupBy(F.col("supersedes").alias("block_id"))
    return rows.agg(_last(F.col("block")).alias("superseded_by"))


def successors(records: DataFrame) -> DataFrame:
    """(block_id, successor), each once."""
    rows = of_type(records, "supersession")
    return rows.select(F.col("supersedes").alias("block_id"), F.col("block").alias("successor")).distinct()


def contested(records: DataFrame) -> DataFrame:
    """(block_id, successor): successors of one block that no other of them supersedes, where two or more are left."""
    every = successors(records)
    counts = every.groupBy("block_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("block_id")
    rivals = every.join(counts, "block_id", "left_semi")
    settled = superseded_by(records).select(F.col("block_id").alias("successor"), F.col("superseded_by").alias("winner"))
    beaten = (
        rivals.join(settled, "successor")
        .join(rivals.select("block_id", F.col("successor").alias("winner")), ["block_id", "winner"], "left_semi")
        .select("block_id", "successor")
    )
    standing = rivals.join(beaten, ["block_id", "successor"], "left_anti")
    left = standing.groupBy("block_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("block_id")
    return standing.join(left, "block_id", "left_semi")


def demoted(records: DataFrame) -> DataFrame:
    return of_type(records, "demotion").select(F.col("block").alias("block_id")).distinct()


def removed(records: DataFrame) -> DataFrame:
    return of_type(records, "removal").select(F.explode("blocks").alias("block_id")).distinct()


def inaccessible(records: DataFrame) -> DataFrame:
    return superseded_by(records).select("block_id").unionByName(demoted(records)).distinct()


def made_by(records: DataFrame, kind: str, producer_id: str, version: str | None = None) -> DataFrame:
    """Blocks whose last derivation is by the producer; any version if none is given."""
    own = (F.col("producer.kind") == kind) & (F.col("producer.id") == producer_id)
    if version is not None:
        own = own & (F.col("producer.version") == version)
    return derivations(records).where(own).select("block_id")
