"""Three-way merges of compositions in one pass: union, three flags, boolean algebra."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.exceptions import AppendOnlyViolation


def sides(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Each (memory_type, block_id).  (memory_type, block_id, base, ours, theirs) with booleans; one shuffle."""
    tagged = None
    for name, df in (("base", base), ("ours", ours), ("theirs", theirs)):
        own = df.select("memory_type", "block_id", *(F.lit(n == name).alias(n) for n in ("base", "ours", "theirs")))
        tagged = own if tagged is None else tagged.unionByName(own)
    return tagged.groupBy("memory_type", "block_id").agg(*(F.bool_or(n).alias(n) for n in ("base", "ours", "theirs")))


def merge(base: DataFrame, ours: DataFrame, theirs: DataFrame, check: bool = True, installed: tuple[set[str], set[str]] | None = None) -> DataFrame:
    """(memory_type, block_id, outcome): kept, added_by_us, added_by_them, added_by_both or removed.

    Exclusion wins over presence: what the base held and a side that holds the module lacks is removed.  A module that
    a side does not hold at all is not removed by it.  An episodic removal is refused.  installed: the modules that we
    and they hold, which also tells an emptied module from an absent one; by default those with blocks.
    """
    flags = sides(base, ours, theirs)
    if installed is not None:
        we, they = (F.col("memory_type").isin(*names) if names else F.lit(False) for names in installed)
        rows = flags.withColumns({"we": we, "they": they})
    else:
        held = flags.groupBy("memory_type").agg(F.bool_or("ours").alias("we"), F.bool_or("theirs").alias("they"))
        rows = flags.join(F.broadcast(held), "memory_type")  # a row for each of five modules
    removed = F.col("base") & ((F.col("we") & ~F.col("ours")) | (F.col("they") & ~F.col("theirs")))
    outcome = (
        F.when(removed, "removed")
        .when(F.col("base"), "kept")
        .when(F.col("ours") & F.col("theirs"), "added_by_both")
        .when(F.col("ours"), "added_by_us")
        .otherwise("added_by_them")
    )
    merged = rows.where(F.col("ours") | F.col("theirs") | (F.col("base") & (F.col("we") | F.col("they"))))
    merged = merged.select("memory_type", "block_id", outcome.alias("outcome"), "ours")
    if check and not merged.where("memory_type = 'episodic' AND outcome = 'removed'").isEmpty():
        raise AppendOnlyViolation("the episodic module is append-only; a history that dropped from it is malformed")
    return merged.select("memory_type", "block_id", "outcome")


def members(merged: DataFrame) -> DataFrame:
    return merged.where("outcome <> 'removed'").select("memory_type", "block_id")


def incoming(merged: DataFrame, ours: DataFrame) -> DataFrame:
    """What enters that we do not hold."""
    return members(merged).join(ours.select("memory_type", "block_id"), ["memory_type", "block_id"], "left_anti")


def withdrawn(merged: DataFrame, ours: DataFrame) -> DataFrame:
    """What we hold and would lose; it needs explicit acceptance."""
    return ours.select("memory_type", "block_id").distinct().join(members(merged), ["memory_type", "block_id"], "left_anti")


def noop_modules(merged: DataFrame) -> DataFrame:
    counts = merged.groupBy("memory_type").agg(
        F.count_if(F.col("outcome").isin("added_by_them", "removed")).alias("n_changes")
    )
    return counts.select("memory_type", (F.col("n_changes") == 0).alias("is_noop"))


def diagnose_missing(missing: DataFrame, removed: DataFrame) -> DataFrame:
    """missing (block_id): dropped_deliberately if a removal record names it, else never_held."""
    known = removed.select("block_id", F.lit(True).alias("r")).distinct()
    why = F.when(F.col("r"), "dropped_deliberately").otherwise("never_held")
    return missing.select("block_id").distinct().join(known, "block_id", "left").select("block_id", why.alias("reason"))
