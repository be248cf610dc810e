"""Quality rules by host (operator 4), in DataFrame functions only.

Base rules, for each document: too few words, or too many words in repeated three-word windows.  A host's failures
are aggregated; its failure rate is shrunk with a beta prior fitted to all hosts by the method of moments (empirical
Bayes), and a host is rejected if its shrunk rate is over host_rate and also over what that prior leaves likely: its mean
and `deviations` of its standard deviations.  So a corpus of equally bad hosts loses none of them, and one bad host among
good ones goes.  Verdicts are joined back: a document is kept if it passes the base rules and its host is not rejected.

Everything about a text is computed inside its row, by array functions: repeated windows are found by sorting the
windows' 64-bit hashes with their places (two different windows of one text with the same hash have a chance of about
n^2 / 2^65).  The features, a few numbers a document, are written once; only they are aggregated and joined, so that
texts are read once and never shuffled.  Counts are summed before the shuffle, and the join on the host has no hint:
Spark broadcasts the hosts where their measured size allows it and splits a hot host otherwise.

Defined results: a null text has no words and fails; documents with a null host form one host; with a single host, or
hosts that do not differ more than chance makes them, the prior is as strong as all documents together (m * n); an
empty table gives an empty result; repeated rows count each.  Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import BLANKS, blank_words, source, strip_blanks, table

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
HOST_RATE = 0.3
DEVIATIONS = 2.0


def text_features(docs: DataFrame, host: Column) -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), host.alias("host"), text.alias("text")).select(
        "*", blank_words(F.col("text")).alias("w")
    )
    n = F.size("w")
    hashes = split.select(
        "doc_id", "host", "text", n.cast("long").alias("n_words"),
        F.when(
            n >= 3,
            F.transform(F.slice("w", F.lit(1), n - 2), lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2))),
        ).otherwise(F.array().cast("array<bigint>")).alias("h"),
    )
    # places of windows found twice or more, by their neighbours in the order of hashes
    in_order = hashes.select(
        "*",
        F.when(
            F.size(F.array_distinct("h")) < F.size("h"),
            F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
        ).alias("s"),
    )
    again = F.filter(
        "s",
        lambda e, k: (F.get("s", k - 1)["h"] == e["h"]).eqNullSafe(True) | (F.get("s", k + 1)["h"] == e["h"]).eqNullSafe(True),
    )
    places = F.flatten(F.transform(again, lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2)))
    lines = F.filter(F.split("text", "\n", -1), lambda x: strip_blanks(x) != "")
    return in_order.select(
        "doc_id", "host", "n_words",
        F.length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.when(F.col("s").isNotNull(), F.size(F.array_distinct(places))).otherwise(0).cast("long").alias("n_repeat_words"),
    ).select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), "n_repeat_words",
    )


def host_verdicts(features: DataFrame, host_rate: float = HOST_RATE, deviations: float = DEVIATIONS) -> DataFrame:
    """features with host and base_failed.  Returns host, n_docs, n_failed, shrunk_rate, host_rejected.

    A bounded number of rows only if hosts are; nothing here is collected: the prior is one row, joined by a constant.
    """
    hosts = features.groupBy("host").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed")
    )
    rate = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg(
        F.sum("n_docs").alias("n"), (F.sum("n_failed") / F.sum("n_docs")).alias("m"),
        F.var_samp(rate).alias("v"), F.avg(1 / F.col("n_docs")).alias("noise"),
    )
    chance = F.col("m") * (1 - F.col("m")) * F.col("noise")  # the variance that hosts of one rate would show
    between = F.coalesce(F.col("v"), F.lit(0.0)) - chance
    strength = F.when(between > 0, F.greatest(F.lit(1.0), F.col("m") * (1 - F.col("m")) / between - 1)).otherwise(F.col("n"))
    prior = prior.select("m", F.least(strength, F.col("n").cast("double")).alias("strength"))
    shrunk = (F.col("n_failed") + F.col("m") * F.col("strength")) / (F.col("n_docs") + F.col("strength"))
    likely = F.col("m") + deviations * F.sqrt(F.col("m") * (1 - F.col("m")) / (F.col("strength") + 1))
    return hosts.crossJoin(F.broadcast(prior)).select(  # one row by construction
        "host", "n_docs", "n_failed", shrunk.alias("shrunk_rate"), ((shrunk > host_rate) & (shrunk > likely)).alias("host_rejected")
    )


def judge(docs: DataFrame, host: Column | None = None, min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT, host_rate: float = HOST_RATE) -> DataFrame:
    host = F.col("source") if host is None else host
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    features = table(text_features(docs, host).withColumn("base_failed", failed), "quality")
    hosts = host_verdicts(features, host_rate).select(F.col("host").alias("own_host"), "shrunk_rate", "host_rejected")
    joined = features.join(hosts, F.col("host").eqNullSafe(F.col("own_host")), "left")
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.col("host_rejected")).alias("kept"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return judge(source(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
tri AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
rep AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM tri),
r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 3)) AS p FROM rep WHERE c >= 2) GROUP BY rid),
ln AS (SELECT rid, line FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dl AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM ln GROUP BY rid),
f AS (SELECT d.rid, doc_id, host, CAST(len(w) AS BIGINT) AS n_words,
  CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(dl.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN r ON d.rid = r.rid LEFT JOIN dl ON d.rid = dl.rid),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
h AS (SELECT host, count(*) AS n, count(*) FILTER (WHERE base_failed) AS k FROM b GROUP BY host),
p AS (SELECT sum(n) AS n, sum(k) / sum(n) AS m, coalesce(var_samp(k / n), 0) AS v, avg(1 / n) AS noise FROM h),
s AS (SELECT m, least(n, CASE WHEN v - m * (1 - m) * noise > 0
  THEN greatest(1.0, m * (1 - m) / (v - m * (1 - m) * noise) - 1) ELSE n END) AS a FROM p),
hv AS (SELECT host, (k + m * a) / (n + a) > 0.3 AND (k + m * a) / (n + a) > m + 2 * sqrt(m * (1 - m) / (a + 1)) AS bad FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT bad AS kept
FROM b JOIN hv ON b.host IS NOT DISTINCT FROM hv.host
"""
