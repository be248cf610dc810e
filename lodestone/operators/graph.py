"""Reachability over edge tables: semi-naive rounds of joins, with lineage cut every round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.plans.scratch import checkpointed


def closure(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """edges (src, dst), seeds (origin, node).  Returns (origin, node, depth): what is reachable from each origin's
    seeds, without the origin itself and without the seeds; depth is the number of the first round that found it.

    Only the frontier is joined; every round's finds are written once, and what was seen is the union of these tables.
    Cycles end where nothing new is found.
    """
    edges = checkpointed(edges.select("src", "dst").distinct())
    frontier, depth = checkpointed(seeds.select("origin", "node").distinct().withColumn("depth", F.lit(0))), 0
    seen = frontier
    while max_depth is None or depth < max_depth:
        depth += 1
        found = frontier.join(edges, F.col("node") == F.col("src")).select("origin", F.col("dst").alias("node")).distinct()
        found = found.where(F.col("node") != F.col("origin")).join(seen, ["origin", "node"], "left_anti")
        frontier = checkpointed(found.withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0")


def cascade(citations: DataFrame, references: DataFrame, members: DataFrame, origins: DataFrame) -> DataFrame:
    """What goes with each origin: (origin, block_id, memory_type, via), via provenance or structure.

    citations (cited, dependent); references (src, dst): src points at dst; members (memory_type, block_id);
    origins (block_id).  First the provenance closure of each origin, of which only members count; then the
    structural closure of the origin and of that.  Provenance is not walked again from what structure finds.
    """
    seeds = origins.select(F.col("block_id").alias("origin"), F.col("block_id").alias("node")).distinct()
    derived = closure(citations.select(F.col("cited").alias("src"), F.col("dependent").alias("dst")), seeds)
    ids = members.select("memory_type", F.col("block_id").alias("node")).distinct()
    derived = checkpointed(derived.select("origin", "node").join(ids.select("node").distinct(), "node", "left_semi").select("origin", "node"))
    pointed = references.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    structural = closure(pointed, seeds.unionByName(derived)).select("origin", "node")
    both = derived.withColumn("via", F.lit("provenance")).unionByName(structural.withColumn("via", F.lit("structure")))
    both = both.groupBy("origin", "node").agg(F.min("via").alias("via"))
    return both.join(ids, "node").select("origin", F.col("node").alias("block_id"), "memory_type", "via")


def cascade_of_batch(found: DataFrame, origins: DataFrame) -> DataFrame:
    """The union over origins without the origins."""
    every = found.select("memory_type", "block_id").distinct()
    return every.join(origins.select("block_id"), "block_id", "left_anti").select("memory_type", "block_id")
