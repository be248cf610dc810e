"""Connected components of links, by alternating large-star and small-star rounds.

Every round is joins and pre-aggregated minima over tables in the shared folder: no node's neighbours are ever
collected, and nothing but three numbers a round (a count and the exact sums of two 64-bit hashes of the edges) comes to
the driver: an edge set that did not change ends the rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import table


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """links: (a, b), any order, repeats and loops allowed.  Returns (node, root): root is the smallest node of its
    component; nodes without links to others are not listed."""
    edges = table(
        links.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        label,
    )
    before = None
    while True:
        wide = lambda h: F.sum(h.cast("decimal(20,0)"))
        now = edges.agg(F.count(F.lit(1)), wide(F.xxhash64("u", "v")), wide(F.xxhash64("v", "u", F.lit(1)))).first()
        if now[0] == 0 or tuple(now) == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = tuple(now)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = table(large.where(F.col("u") != F.col("v")).distinct(), label)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v")))
        edges = table(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), label)
