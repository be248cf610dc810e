"""Retrieval indices as derived tables: postings with IDF, hashed vectors, dense vectors, rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import tokens

DIMENSIONS = 256
FUSION_K = 4
POOL_FACTOR, POOL_LEAST = 5, 50


def postings(blocks: DataFrame) -> DataFrame:
    """blocks (block_id, text): (token, block_id, tf)."""
    return blocks.select("block_id", F.explode(tokens(F.col("text"))).alias("token")).groupBy("token", "block_id").agg(
        F.count(F.lit(1)).alias("tf")
    )


def query_tokens(spark, text: str) -> DataFrame:
    return spark.createDataFrame([(text,)], "text string").select(F.explode(tokens(F.col("text"))).alias("token")).distinct()


def idf_search(index: DataFrame, n_blocks: int, query: DataFrame) -> DataFrame:
    """(block_id, score): the share of the query's IDF that a block's distinct tokens hold; idf = ln(1 + N / df)."""
    wanted = query.select("token").distinct()
    hits = index.join(wanted, "token", "left_semi")
    df = hits.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    weights = df.select("token", F.log(1 + F.lit(n_blocks) / F.col("df")).alias("idf"))
    total = weights.agg(F.sum("idf").alias("total"))
    sums = hits.join(weights, "token").groupBy("block_id").agg(F.sum("idf").alias("s"))
    return sums.crossJoin(total).select("block_id", (F.col("s") / F.col("total")).alias("score"))  # total is one row


def hashed_vectors(blocks: DataFrame) -> DataFrame:
    """blocks (block_id, text): sparse (block_id, bucket, value), L2-normalised, six decimals."""
    token = blocks.select("block_id", F.explode(tokens(F.col("text"))).alias("token")).withColumn("h", F.sha2("token", 256))
    bucket = (F.conv(F.substring("h", 1, 8), 16, 10).cast("long") % DIMENSIONS).cast("int")
    sign = F.when(F.conv(F.substring("h", 9, 2), 16, 10).cast("int") % 2 == 1, 1).otherwise(-1)
    raw = token.groupBy("block_id", bucket.alias("bucket")).agg(F.sum(sign).alias("v"))
    norms = raw.groupBy("block_id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return raw.join(norms, "block_id").where("norm > 0").select("block_id", "bucket", F.round(F.col("v") / F.col("norm"), 6).alias("value"))


def vector_search(vectors: DataFrame, query: DataFrame) -> DataFrame:
    """query (bucket, value): (block_id, score) with a positive dot product."""
    q = query.select("bucket", F.col("value").alias("q"))  # DIMENSIONS rows at most
    dots = vectors.join(F.broadcast(q), "bucket").groupBy("block_id").agg(F.sum(F.col("value") * F.col("q")).alias("score"))
    return dots.where("score > 0")


def dense_search(vectors: DataFrame, query: list[float], column: str = "embedding") -> DataFrame:
    """(vec_id, score) by dot product with a dense query vector, which is a literal."""
    q = F.array(*map(F.lit, query))
    dot: Column = F.aggregate(F.zip_with(F.col(column), q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    return vectors.select("vec_id", dot.alias("score"))


def ranked(found: DataFrame, limit: int, key: str = "block_id") -> DataFrame:
    """The best `limit` rows with their rank from 1; the window only sees those."""
    best = found.orderBy(F.desc("score"), key).limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))


def fuse(rankings: list[DataFrame], eligible: DataFrame, limit: int) -> DataFrame:
    """Reciprocal rank fusion over pools of max(5 * limit, 50); (block_id, score), score normalised, four decimals."""
    pool = max(POOL_FACTOR * limit, POOL_LEAST)
    every = None
    for found in rankings:
        own = ranked(found.join(eligible.select("block_id"), "block_id", "left_semi"), pool)
        own = own.select("block_id", (1 / (FUSION_K + F.col("rank"))).alias("w"))
        every = own if every is None else every.unionByName(own)
    best = len(rankings) / (FUSION_K + 1)
    fused = every.groupBy("block_id").agg((F.sum("w") / best).alias("score"))
    return fused.orderBy(F.desc("score"), "block_id").limit(limit)
