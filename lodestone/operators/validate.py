"""The gate for proposed rows: every rule is a DataFrame of issues, a verdict is their fold.

Candidates: (candidate, memory_type, block_id, label, subject, kind, statement, evidence, cited, relations, content,
required): evidence is what the payload says, cited what the proposer says; required is null or what is missing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.identity import is_media_type

ISSUE = ["candidate", "code", "detail"]
PROPOSABLE = ("episodic", "semantic", "procedural")
REVIEW_CODES = ("contradiction", "pending-review", "competing-supersession")


def _issue(rows: DataFrame, code: str, detail) -> DataFrame:
    return rows.select("candidate", F.lit(code).alias("code"), F.coalesce(detail.cast("string"), F.lit("")).alias("detail"))


def type_not_allowed(candidates: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    bad = candidates.where(~F.coalesce(F.col("memory_type").isin(*allowed), F.lit(False)))
    return _issue(bad, "memory-type-not-allowed", F.col("memory_type"))


def schema_broken(candidates: DataFrame) -> DataFrame:
    return _issue(candidates.where(F.col("required").isNotNull()), "schema", F.col("required"))


def evidence_mismatch(candidates: DataFrame) -> DataFrame:
    """Payload evidence, where there is any, and cited evidence are the same sets."""
    differ = (F.size(F.array_except("evidence", "cited")) > 0) | (F.size(F.array_except("cited", "evidence")) > 0)
    return _issue(candidates.where(F.col("evidence").isNotNull() & F.coalesce(differ, F.lit(True))), "evidence-mismatch", F.lit(""))


def evidence_not_found(candidates: DataFrame, canonical: DataFrame) -> DataFrame:
    cited = candidates.select("candidate", F.explode(F.coalesce("evidence", "cited")).alias("block_id"))
    return _issue(cited.join(canonical.select("block_id"), "block_id", "left_anti"), "evidence-not-found", F.col("block_id"))


def duplicates(candidates: DataFrame, held: DataFrame) -> DataFrame:
    return _issue(candidates.join(held.select("memory_type", "block_id"), ["memory_type", "block_id"], "left_semi"), "duplicate", F.col("block_id"))


def relation_target_not_found(candidates: DataFrame, held: DataFrame) -> DataFrame:
    targets = candidates.select("candidate", F.explode(F.transform("relations", lambda r: r["target"])).alias("block_id"))
    return _issue(targets.join(held.select("block_id"), "block_id", "left_anti"), "relation-target-not-found", F.col("block_id"))


def content_mismatch(candidates: DataFrame, blobs: DataFrame) -> DataFrame:
    """blobs (digest, size): named content has a bare media type and the size of the held bytes."""
    named = candidates.where(F.col("content").isNotNull()).select("candidate", "content.*")
    joined = named.join(blobs.select(F.col("digest").alias("blob"), F.col("size").alias("held")), "blob", "left")
    wrong = ~is_media_type(F.col("media_type")) | (F.col("held").isNotNull() & (F.col("held") != F.col("size")))
    return _issue(joined.where(wrong), "content-mismatch", F.col("blob"))


def contradictions(candidates: DataFrame, held: DataFrame) -> DataFrame:
    """The same (label, subject, kind) as a held claim with another statement; never within the batch.

    Held claims are folded first: the smallest and largest statement of a claim tell whether one differs from a
    candidate's, so a hot label is one row, not a product.
    """
    claims = held.where(F.col("memory_type") == "semantic").groupBy("label", "subject", "kind").agg(
        F.min("statement").alias("low"), F.max("statement").alias("high")
    )
    own = candidates.where(F.col("memory_type") == "semantic").alias("c")
    same = (F.col("c.label") == F.col("h.label")) & F.col("c.subject").eqNullSafe(F.col("h.subject")) & (F.col("c.kind") == F.col("h.kind"))
    joined = own.join(claims.alias("h"), same).where((F.col("low") != F.col("c.statement")) | (F.col("high") != F.col("c.statement")))
    return _issue(joined.select("c.candidate", "c.label"), "contradiction", F.col("label"))


def undecided(candidates: DataFrame) -> DataFrame:
    return _issue(candidates, "pending-review", F.lit(""))


def issues(candidates: DataFrame, held: DataFrame, blobs: DataFrame, allowed: tuple[str, ...] = PROPOSABLE, review: bool = False, check_duplicates: bool = True) -> DataFrame:
    """held: (memory_type, block_id, label, subject, kind, statement) of all modules."""
    canonical = held.where(F.col("memory_type") == "canonical")
    found = [
        type_not_allowed(candidates, allowed), schema_broken(candidates), evidence_mismatch(candidates),
        evidence_not_found(candidates, canonical), relation_target_not_found(candidates, held),
        content_mismatch(candidates, blobs), contradictions(candidates, held),
    ]
    if check_duplicates:
        found.append(duplicates(candidates, held))
    if review:
        found.append(undecided(candidates))
    return reduce(DataFrame.unionByName, found)


def verdicts(candidates: DataFrame, found: DataFrame) -> DataFrame:
    """(candidate, status, codes, n_issues)."""
    folded = found.groupBy("candidate").agg(F.array_sort(F.collect_set("code")).alias("codes"), F.count(F.lit(1)).alias("n"))
    beyond = lambda codes: F.size(F.array_except("codes", F.array(*map(F.lit, codes)))) > 0
    status = (
        F.when(F.col("codes").isNull(), "validated")
        .when(~beyond(["contradiction"]), "contradicted")
        .when(~beyond(REVIEW_CODES), "pending_review")
        .otherwise("rejected")
    )
    joined = candidates.select("candidate").join(folded, "candidate", "left")
    none = F.array().cast("array<string>")
    return joined.select(
        "candidate", status.alias("status"), F.coalesce("codes", none).alias("codes"), F.coalesce("n", F.lit(0)).alias("n_issues")
    )


def committable(candidates: DataFrame, judged: DataFrame) -> DataFrame:
    return candidates.join(judged.where("status = 'validated'").select("candidate"), "candidate", "left_semi")
