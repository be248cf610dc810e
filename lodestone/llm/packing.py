"""Packing (operator 1): optimal length buckets and token-budget batches.

A document has its words [^\\x20\\x09-\\x0D]+ and one end as tokens.  Documents longer than max_len are cut into
pieces of max_len tokens and a rest, so that whole texts are packed and the global histogram of piece lengths has at
most max_len rows, however large the input: that bound is why it may come to the driver.  There, dynamic programming
chooses the bucket boundaries with the least padding in all: over the sorted lengths L with counts c, the cost of a
bucket that ends at L[j] is sum(c * (L[j] - L[i])), and a hull of lines gives each layer in linear time.

Inside a bucket pieces are ordered by (length, doc_id, piece) and every batch takes budget // boundary of them, so
only the last batch of a bucket is not full.  The order is global but nothing is sorted in one task: a range
partition deals the pieces out, each partition counts its rows of a bucket, and the running sums of these counts
(partitions x buckets rows at most) are the offsets of the ranks.

Defined results: null and empty texts have one token, the end; repeated rows are packed each; pieces with the same
length and doc_id have ranks in any order; an empty table gives an empty result.  Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import blank_words, source, table

MAX_LEN = 2048
BUCKETS = 16
BUDGET = 65_536


def choose_boundaries(histogram: dict[int, int], buckets: int) -> list[int]:
    """The upper ends of at most `buckets` buckets that minimise the padding; ties go to the earlier cut."""
    lengths = sorted(histogram)
    n = len(lengths)
    if not n:
        return []
    count, mass = [0], [0]
    for length in lengths:
        count.append(count[-1] + histogram[length])
        mass.append(mass[-1] + histogram[length] * length)
    best = [lengths[j - 1] * count[j] - mass[j] if j else 0 for j in range(n + 1)]  # one bucket
    cuts = [[0] * (n + 1)]
    for k in range(2, min(buckets, n) + 1):
        # best'[j] = L[j]*C[j] - S[j] + min over i < j of (best[i] + S[i]) - L[j]*C[i]
        hull: list[tuple[int, int, int]] = []  # slope C[i], height best[i] + S[i], i
        layer, cut, at = [0] * (n + 1), [0] * (n + 1), 0
        for j in range(1, n + 1):
            i = j - 1
            if i >= k - 1:
                line = (count[i], best[i] + mass[i], i)
                while len(hull) >= 2 and _useless(hull[-2], hull[-1], line):
                    hull.pop()
                hull.append(line)
                at = min(at, len(hull) - 1)
            if not hull:
                layer[j], cut[j] = best[j], cuts[-1][j]
                continue
            x = lengths[j - 1]
            value = lambda p: hull[p][1] - x * hull[p][0]
            while at + 1 < len(hull) and value(at + 1) < value(at):
                at += 1
            layer[j], cut[j] = x * count[j] - mass[j] + value(at), hull[at][2]
        cuts.append(cut)
        best = layer
    ends, j = [], n
    for cut in reversed(cuts):
        if j == 0:
            break
        ends.append(lengths[j - 1])
        j = cut[j]
    return ends[::-1]


def _useless(a: tuple, b: tuple, c: tuple) -> bool:
    """Slopes rise; b is never below both a and c."""
    return (c[1] - a[1]) * (b[0] - a[0]) <= (b[1] - a[1]) * (c[0] - a[0])


def padding(histogram: dict[int, int], ends: list[int]) -> int:
    return sum(c * (min(e for e in ends if e >= length) - length) for length, c in histogram.items())


def pieces(docs: DataFrame, max_len: int, length: Column | None = None) -> DataFrame:
    """doc_id, piece, first_token, n_tokens."""
    n = length if length is not None else F.size(blank_words(F.col("text"))) + 1
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), n.cast("long").alias("n"))
    starts = whole.select("doc_id", "n", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(max_len).cast("long"))))
    return starts.select(
        "doc_id", F.col("pos").cast("long").alias("piece"), F.col("col").alias("first_token"),
        F.least(F.lit(max_len).cast("long"), F.col("n") - F.col("col")).alias("n_tokens"),
    )


def pack(docs: DataFrame, max_len: int = MAX_LEN, buckets: int = BUCKETS, budget: int = BUDGET, length: Column | None = None) -> DataFrame:
    """doc_id, piece, first_token, n_tokens, bucket, bucket_len, batch, slot, padding: a row for each piece."""
    if budget < max_len:
        raise ValueError("a batch must hold the longest piece")
    cut = table(pieces(docs, max_len, length), "pieces")
    histogram = {r.n_tokens: r.n for r in cut.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()}
    ends = choose_boundaries(histogram, buckets) or [max_len]
    bucket = F.lit(len(ends) - 1)
    for k in range(len(ends) - 2, -1, -1):
        bucket = F.when(F.col("n_tokens") <= ends[k], F.lit(k)).otherwise(bucket)
    dealt = cut.withColumn("bucket", bucket.cast("int")).repartitionByRange("bucket", "n_tokens", "doc_id", "piece")
    dealt = dealt.sortWithinPartitions("bucket", "n_tokens", "doc_id", "piece").select(
        "*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")
    )
    dealt = table(dealt, "pieces-in-order")
    counts = dealt.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first_row"))
    before = F.sum("n").over(Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("bucket", "part", "first_row", F.coalesce(before, F.lit(0)).alias("offset"))
    rank = F.col("offset") + F.col("row") - F.col("first_row")
    size = F.element_at(F.array(*map(F.lit, ends)), F.col("bucket") + 1).cast("long")
    per_batch = F.floor(F.lit(budget) / F.col("bucket_len"))
    return (
        dealt.join(offsets, ["bucket", "part"])
        .select("doc_id", "piece", "first_token", "n_tokens", "bucket", size.alias("bucket_len"), rank.alias("rank"))
        .select(
            "doc_id", "piece", "first_token", "n_tokens", "bucket", "bucket_len",
            F.floor(F.col("rank") / per_batch).alias("batch"), (F.col("rank") % per_batch).cast("long").alias("slot"),
            (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
        )
    )


def query(spark, sf_dir: str) -> DataFrame:
    return pack(source(spark, sf_dir, "documents"))
