"""Retrieval over block views.

A block view is (block_id, memory_type, subject, tags, evidence, occurred_at, haystack, payload), with haystack the
folded searchable text.  All of a query is one lazy plan: filters, term coverage as substring tests of literals (no
join with the terms), accessibility by anti-join, and a top-k that Spark runs as TakeOrderedAndProject.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.exceptions import BlockIntegrityError, QueryError
from lodestone.functions.identity import DIGEST
from lodestone.functions.text import content_terms, coverage, score_text
from lodestone.operators.graph import closure


#: Only exact changes a scan; the others are hints to a planner.
MODES = ("auto", "exact", "lexical", "semantic", "associative")


@dataclass(frozen=True)
class Query:
    text: str = ""
    memory_types: tuple[str, ...] | None = None
    subject: str | None = None
    tags: tuple[str, ...] = ()
    evidence: tuple[str, ...] = ()
    since: str | None = None
    until: str | None = None
    include_superseded: bool = False
    mode: str = "auto"
    expand_depth: int = 0
    limit: int = 10
    terms: list[str] = field(init=False, default_factory=list)

    def __post_init__(self):
        if self.limit < 1 or self.expand_depth < 0:
            raise QueryError("limit must be 1 or more and expand_depth 0 or more")
        if self.mode not in MODES:
            raise QueryError(f"unknown mode {self.mode!r}")
        object.__setattr__(self, "terms", content_terms(self.text))

    @property
    def is_filter_only(self) -> bool:
        return not self.text.strip()


def passes(query: Query) -> Column:
    """The filters; a null field never passes a filter on it."""
    keep = F.lit(True)
    if query.subject is not None:
        keep = keep & F.coalesce(F.col("subject") == query.subject, F.lit(False))
    if query.tags:
        wanted = F.array(*map(F.lit, query.tags))
        keep = keep & (F.size(F.array_except(wanted, F.coalesce("tags", F.array().cast("array<string>")))) == 0)
    if query.evidence:
        keep = keep & F.coalesce(F.arrays_overlap("evidence", F.array(*map(F.lit, query.evidence))), F.lit(False))
    if query.since is not None or query.until is not None:
        keep = keep & F.col("occurred_at").isNotNull()
    if query.since is not None:
        keep = keep & (F.col("occurred_at") >= query.since)
    if query.until is not None:
        keep = keep & (F.col("occurred_at") <= query.until)
    return keep


def citing(blocks: DataFrame, evidence: DataFrame) -> DataFrame:
    """Views that cite any of the ids in evidence (block_id): the evidence filter for sets too large for a request."""
    each = blocks.where("evidence IS NOT NULL").select("block_id", F.explode("evidence").alias("cited")).distinct()
    hit = each.join(evidence.select(F.col("block_id").alias("cited")).distinct(), "cited", "left_semi").select("block_id").distinct()
    return blocks.join(hit, "block_id", "left_semi")


def searched(blocks: DataFrame, query: Query) -> DataFrame:
    return blocks if query.memory_types is None else blocks.where(F.col("memory_type").isin(*query.memory_types))


def candidates(blocks: DataFrame, query: Query, relations: DataFrame | None = None, hidden: DataFrame | None = None, unresolvable: DataFrame | None = None) -> DataFrame:
    """(block_id, score) before order and limit.

    relations (src, dst) are followed to expand_depth with score 0, past the filters; hidden (block_id) is superseded
    or demoted; unresolvable (block_id) has no bytes any more.
    """
    own = searched(blocks, query)
    live = own if unresolvable is None else own.join(unresolvable, "block_id", "left_anti")
    if query.mode == "exact":
        import re

        if not re.fullmatch(DIGEST.strip("^$"), query.text):
            found = own.where(F.lit(False)).select("block_id", F.lit(1.0).alias("score"))
        else:
            found = own.where(F.col("block_id") == query.text).select("block_id", F.lit(1.0).alias("score")).distinct()
    else:
        scored = live.where(passes(query)).select("block_id", coverage(F.col("haystack"), query.terms).cast("double").alias("score"))
        found = scored.where(F.col("score") > 0)
        if query.expand_depth > 0 and relations is not None:
            edges = relations.join(
                live.where(F.col("memory_type") == "semantic").select(F.col("block_id").alias("src")), "src", "left_semi"
            )
            seeds = found.select(F.lit("").alias("origin"), F.col("block_id").alias("node"))
            more = closure(edges, seeds, query.expand_depth).select(F.col("node").alias("block_id"), F.lit(0.0).alias("score"))
            found = found.unionByName(more)
    if not query.include_superseded and hidden is not None:
        found = found.join(hidden.select("block_id"), "block_id", "left_anti")
    return found


def top(found: DataFrame, query: Query) -> DataFrame:
    return found.orderBy(F.desc("score"), "block_id").limit(query.limit)


def is_truncated(found: DataFrame, query: Query) -> bool:
    """More candidates than the limit, counting those outside the searched modules."""
    return found.limit(query.limit + 1).count() > query.limit


def matches(found: DataFrame, blocks: DataFrame, query: Query, locators: DataFrame, superseded: DataFrame, unresolvable: DataFrame | None = None) -> DataFrame:
    """(block_id, memory_type, content, score, sources, verified, resolvable, superseded_by), limit rows at most; what
    was found outside the searched modules takes a slot and is then left out.  verified is the views' own: whether the
    bytes that were read still hash to the id; views without it were not read from a store."""
    chosen = top(found, query).select("block_id", "score")
    checked = F.col("verified") if "verified" in blocks.columns else F.lit(True)
    own = searched(blocks, query).select("block_id", "memory_type", "payload", "evidence", checked.alias("verified"))
    joined = F.broadcast(chosen).join(own, "block_id") if query.limit <= 10_000 else chosen.join(own, "block_id")
    if unresolvable is None:
        joined = joined.withColumn("resolvable", F.lit(True))
    else:
        gone = unresolvable.select("block_id", F.lit(False).alias("r")).distinct()
        joined = joined.join(gone, "block_id", "left").withColumn("resolvable", F.coalesce("r", F.lit(True)))
    joined = joined.join(locators, "block_id", "left").join(superseded, "block_id", "left")
    cited = F.transform(
        F.coalesce("evidence", F.array().cast("array<string>")), lambda e: F.struct(e.alias("block_id"), F.col("locator").alias("locator"))
    )
    none = F.array().cast("array<struct<block_id:string,locator:string>>")
    return joined.select(
        "block_id", "memory_type", F.when(F.col("resolvable"), F.col("payload")).otherwise("{}").alias("content"),
        score_text(F.col("score")).alias("score"), F.when(F.col("resolvable"), cited).otherwise(none).alias("sources"),
        "verified", "resolvable", "superseded_by",
    )


def all_verified(bundle: DataFrame) -> bool:
    """No match whose bytes do not hash to its id."""
    return bundle.where(~F.col("verified")).isEmpty()


def require_verified(bundle: DataFrame) -> DataFrame:
    bad = [r.block_id for r in bundle.where(~F.col("verified")).select("block_id").limit(5).collect()]
    if bad:
        raise BlockIntegrityError(f"bytes do not hash to {', '.join(bad)}")
    return bundle


def resolve(blocks: DataFrame, block_id: str, order: tuple[str, ...]) -> DataFrame:
    """The first module, in their order, that holds the id."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("memory_type"))
    return blocks.where(F.col("block_id") == block_id).orderBy(place).limit(1)


def resolvability(names: DataFrame, blobs: DataFrame, tombstones: DataFrame) -> DataFrame:
    """(memory_type, status, n): what a module names, each digest once; see status_of."""
    found = status_of(names, blobs, tombstones)
    return found.groupBy("memory_type", "status").agg(F.count(F.lit(1)).alias("n"))


def status_of(names: DataFrame, blobs: DataFrame, tombstones: DataFrame) -> DataFrame:
    """names (memory_type, digest), blobs (digest), tombstones (digest).  (memory_type, digest, status)."""
    held = blobs.select("digest", F.lit(1).alias("b")).distinct()
    dead = tombstones.select("digest", F.lit(1).alias("t")).distinct()
    status = F.when(F.col("t").isNotNull(), "tombstoned").when(F.col("b").isNotNull(), "resolvable").otherwise("missing")
    joined = names.select("memory_type", "digest").distinct().join(held, "digest", "left").join(dead, "digest", "left")
    return joined.select("memory_type", "digest", status.alias("status"))
