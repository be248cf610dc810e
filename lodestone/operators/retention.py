"""Marking, sweeping and redaction as set operations; the policy's rules on the driver."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.exceptions import RetentionPolicyError


@dataclass(frozen=True)
class RetentionPolicy:
    allowed_mechanisms: tuple[str, ...] | None = None
    droppable_modules: tuple[str, ...] = ("canonical", "semantic", "procedural")
    canonical_drop_allowed: bool = False
    redactable_media_types: tuple[str, ...] = ()
    cascade_review_threshold: int | None = None
    retained_roots: int = 10

    @property
    def record_removals(self) -> bool:
        return True

    def authorize(self, mechanism: str, memory_type: str) -> None:
        drop = mechanism == "drop"
        if drop and memory_type == "episodic":
            raise RetentionPolicyError("the episodic module is append-only")
        if self.allowed_mechanisms is not None and mechanism not in self.allowed_mechanisms:
            raise RetentionPolicyError(f"{mechanism} is not among the allowed mechanisms")
        if drop and memory_type not in self.droppable_modules:
            raise RetentionPolicyError(f"nothing may be dropped from {memory_type}")
        if drop and memory_type == "canonical" and not self.canonical_drop_allowed:
            raise RetentionPolicyError("dropping canonical evidence is privileged")
        if mechanism in ("tombstone", "crypto_shred", "lineage_rewrite") and not self.redactable_media_types:
            raise RetentionPolicyError("no media type may be redacted")

    def requires_review(self, cascade_size: int) -> bool:
        return self.cascade_review_threshold is not None and cascade_size > self.cascade_review_threshold


def content_named(blocks: DataFrame) -> DataFrame:
    """blocks (block_id, content array<string>): (block_id, digest)."""
    return blocks.select("block_id", F.explode("content").alias("digest")).where(F.col("digest").isNotNull())


def mark(compositions: DataFrame, blocks: DataFrame, others: DataFrame) -> DataFrame:
    """compositions (block_id) of all retained snapshots, others (digest): snapshot and composition documents, parents."""
    ids = compositions.select(F.col("block_id").alias("digest")).distinct()
    named = content_named(blocks).join(ids.select(F.col("digest").alias("block_id")), "block_id", "left_semi").select("digest")
    return ids.unionByName(named).unionByName(others.select("digest")).distinct()


def sweep(held: DataFrame, keep: DataFrame) -> DataFrame:
    return held.select("digest").distinct().join(keep, "digest", "left_anti")


def redactable(target: DataFrame, members: DataFrame, blocks: DataFrame) -> DataFrame:
    """target (block_id): the digests to destroy, the blocks and their content that no other live block names."""
    own = content_named(blocks.join(target, "block_id", "left_semi")).select("digest").distinct()
    others = blocks.join(members.select("block_id"), "block_id", "left_semi").join(target, "block_id", "left_anti")
    shared = content_named(others).select("digest").distinct()
    return target.select(F.col("block_id").alias("digest")).unionByName(own.join(shared, "digest", "left_anti")).distinct()
