"""Merkle aggregation over sets of block ids: RFC 9162 trees over sorted leaves.

Pairing neighbours and promoting an odd last node, level by level, is the RFC's split at the largest power of two.
So 2^BLOCK neighbouring leaves (a bounded group) are one row, `packed` as raw digests and written once; such rows fold
with array functions, and a root takes one shuffle for every BLOCK levels, whatever the size of the set.  Proofs are made
inside these rows and leave them last, so that paths, the largest part, are never shuffled or stored.  Nothing is sorted
or hashed on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.exceptions import LayoutError
from lodestone.functions.identity import EMPTY_ROOT, hex_of, is_digest, raw_of
from lodestone.operators.ordering import ranked
from lodestone.plans.scratch import checkpointed

BLOCK = 10
LAYOUT = "rfc6962-sorted/1"
#: Layouts by name, each a function of (ids, group) to roots; more may be registered.
LAYOUTS: dict = {}


def hash_leaf(hex_digest: Column) -> Column:
    return F.sha2(F.unhex(F.concat(F.lit("00"), hex_digest)), 256)


def hash_node(left: Column, right: Column) -> Column:
    return F.sha2(F.unhex(F.concat(F.lit("01"), left, right)), 256)


def is_node_hash(value: Column) -> Column:
    return F.coalesce(value.rlike("^[0-9a-f]{64}$"), F.lit(False))


def leaves(ids: DataFrame, group: str = "memory_type") -> DataFrame:
    """ids: (group, block_id), repeats allowed.  Returns (group, block_id, pos, hash)."""
    distinct = ids.select(group, "block_id").distinct()
    return ranked(distinct, group, "block_id").withColumn("hash", hash_leaf(hex_of(F.col("block_id"))))


def _fold(hashes: Column) -> Column:
    """One level: neighbours joined, an odd last one promoted."""
    pairs = F.sequence(F.lit(0), F.floor((F.size(hashes) - 1) / 2).cast("int"))
    return F.transform(
        pairs,
        lambda i: F.when(2 * i + 1 < F.size(hashes), hash_node(F.get(hashes, 2 * i), F.get(hashes, 2 * i + 1))).otherwise(
            F.get(hashes, 2 * i)
        ),
    )


def packed(ids: DataFrame, group: str = "memory_type") -> DataFrame:
    """ids: (group, block_id), repeats allowed.  Returns (group, block, n, own): 2^BLOCK neighbours in order, as raw digests.

    A range partition brings repeats together, so they go before anything else is moved.
    """
    bad = F.raise_error(F.concat(F.lit("not a digest: "), F.coalesce("block_id", F.lit("null")))).cast("binary")
    raw = ids.select(group, F.when(is_digest(F.col("block_id")), raw_of(F.col("block_id"))).otherwise(bad).alias("id"))
    placed = ranked(raw.repartitionByRange(group, "id").distinct(), group, "id", dealt=True)
    rows = placed.groupBy(group, F.shiftright("pos", BLOCK).alias("block")).agg(F.sort_array(F.collect_list("id")).alias("own"))
    return checkpointed(rows.select(group, "block", F.size("own").alias("n"), "own"))


def _sizes(rows: DataFrame, group: str) -> tuple[DataFrame, int]:
    """(group, tree_size) of packed rows, measured so that Spark knows how small it is, and the largest of them."""
    sizes = checkpointed(rows.groupBy(group).agg(F.sum("n").alias("tree_size")))
    return sizes, sizes.agg(F.max("tree_size")).first()[0] or 0


def _leaf_hashes(own: Column) -> Column:
    return F.transform(own, lambda x: F.sha2(F.concat(F.lit(b"\x00"), x), 256))


def _top(tree: Column) -> Column:
    return F.get(tree, F.lit(0))


def _folded(rows: DataFrame) -> DataFrame:
    """rows with h0, the hashes of a block: and h1 to h<BLOCK>, the levels above them."""
    for level in range(BLOCK):
        rows = rows.withColumn(f"h{level + 1}", _fold(F.col(f"h{level}")))
    return rows


def _tops(rows: DataFrame, group: str) -> DataFrame:
    """(group, pos, hash): the node over each block, a row for 2^BLOCK of those below."""
    return checkpointed(_folded(rows).select(group, F.col("block").alias("pos"), _top(F.col(f"h{BLOCK}")).alias("hash")))


def _blocks_of(nodes: DataFrame, group: str) -> DataFrame:
    """nodes (group, pos, hash) as (group, block, at, h0)."""
    own = F.array_sort(F.collect_list(F.struct("pos", "hash")))
    rows = nodes.groupBy(group, F.shiftright("pos", BLOCK).alias("block")).agg(own.alias("own"))
    return rows.select(group, "block", F.col("own.pos").alias("at"), F.col("own.hash").alias("h0"))


def roots(ids: DataFrame, group: str = "memory_type") -> DataFrame:
    """(group, root, n_blocks).  Groups without ids have no row; their root is EMPTY_ROOT."""
    return packed_roots(packed(ids, group), group)


def packed_roots(rows: DataFrame, group: str = "memory_type") -> DataFrame:
    """roots of packed rows."""
    sizes, largest = _sizes(rows, group)
    now = _tops(rows.select(group, "block", _leaf_hashes(F.col("own")).alias("h0")), group)
    while largest > 1 << BLOCK:
        now = _tops(_blocks_of(now, group), group)
        largest = -(-largest >> BLOCK)
    return now.join(sizes, group).select(group, F.col("hash").alias("root"), F.col("tree_size").alias("n_blocks"))


def levels(ids: DataFrame, group: str = "memory_type") -> DataFrame:
    """(group, level, pos, hash): every node of every tree, each once."""
    placed = leaves(ids, group)
    sizes = placed.groupBy(group).agg(F.count(F.lit(1)).alias("size"))
    now = checkpointed(placed.join(sizes, group).select(group, F.lit(0).alias("level"), "pos", "hash", "size"))
    every, n, level = now, now.agg(F.max("size")).first()[0] or 0, 0
    while n > 1:
        level += 1
        pair = F.struct("pos", "hash")
        now = now.where("size > 1").groupBy(group, F.shiftright("pos", 1).alias("pos"), F.expr("(size + 1) div 2").alias("size")).agg(
            F.min(pair)["hash"].alias("l"), F.max(pair)["hash"].alias("r"), F.count(F.lit(1)).alias("n")
        )
        node = F.when(F.col("n") == 2, hash_node(F.col("l"), F.col("r"))).otherwise(F.col("l"))
        now = checkpointed(now.select(group, F.lit(level).alias("level"), "pos", node.alias("hash"), "size"))
        every = every.unionByName(now)
        n = (n + 1) // 2
    return every.drop("size")


def _with_paths(rows: DataFrame, group: str, largest: int) -> DataFrame:
    """rows (group, block, h0) and whatever else they have, with paths and rest: the siblings of each of h0 in its block, and theirs from there to the root.

    A row has the levels of its subtree, so every member's siblings inside it; the subtrees' own nodes are the next
    round's members, and their paths come back to the rows before these are folded, while they are small.  A level
    without a sibling is skipped.
    """
    if largest > 1 << BLOCK:
        above = _with_paths(_blocks_of(_tops(rows, group), group), group, -(-largest >> BLOCK))
        above = above.select(group, "rest", F.inline(F.arrays_zip("at", "paths")))
        rows = rows.join(above.select(group, F.col("at").alias("block"), F.concat("paths", "rest").alias("rest")), [group, "block"])
    else:
        rows = rows.withColumn("rest", F.array().cast("array<string>"))

    def path(_own: Column, i: Column) -> Column:
        siblings = (F.get(f"h{k}", F.shiftright(i, k).bitwiseXOR(F.lit(1))) for k in range(BLOCK))
        return F.array_compact(F.array(*siblings))

    return _folded(rows).withColumn("paths", F.transform("h0", path))


def proofs(ids: DataFrame, group: str = "memory_type") -> DataFrame:
    """(group, block_id, leaf_index, tree_size, audit_path): siblings from the leaf up; levels without a sibling are skipped."""
    return packed_proofs(packed(ids, group), group)


def packed_proofs(rows: DataFrame, group: str = "memory_type", beside: DataFrame | None = None) -> DataFrame:
    """proofs of packed rows.  beside: a row for each group, (group, root), joined to whole blocks; groups it lacks have no proofs."""
    sizes, largest = _sizes(rows, group)
    rows = rows.join(sizes, group)
    rows = rows if beside is None else rows.join(beside.select(group, "root"), group)
    found = _with_paths(rows.withColumn("h0", _leaf_hashes(F.col("own"))), group, largest)
    more = [] if beside is None else ["root"]
    found = found.select(group, "block", "tree_size", "rest", *more, F.posexplode(F.arrays_zip("own", "paths")).alias("i", "leaf"))
    return found.select(
        group, F.concat(F.lit("sha256:"), F.lower(F.hex("leaf.own"))).alias("block_id"),
        (F.shiftleft("block", BLOCK) + F.col("i")).alias("leaf_index"), "tree_size", F.concat("leaf.paths", "rest").alias("audit_path"), *more,
    )


def proof_holds(block: Column, leaf_index: Column, tree_size: Column, path: Column, root: Column) -> Column:
    """The RFC's walk as one expression, a hash for each of the path: false for a wrong leaf, index, length or hash.

    Below the level where the index meets that of the last leaf every level has a sibling, on the side of the index's bit;
    from there up only set bits have one, on the left.
    """
    index, last = leaf_index.cast("long"), (tree_size - 1).cast("long")
    apart = index.bitwiseXOR(last)
    levels = F.when(apart == 0, 0).otherwise(F.length(F.bin(apart)))
    above = F.call_function("shiftright", index, levels)
    start = F.struct(
        F.call_function("shiftleft", F.lit(-1).cast("long"), levels).bitwiseOR(index).alias("left"), hash_leaf(hex_of(block)).alias("hash")
    )

    def step(s: Column, sibling: Column) -> Column:
        left = s["left"].bitwiseAND(F.lit(1).cast("long")) == 1
        joined = F.when(left, hash_node(sibling, s["hash"])).otherwise(hash_node(s["hash"], sibling))
        return F.struct(F.shiftright(s["left"], 1).alias("left"), joined.alias("hash"))

    fits = (leaf_index >= 0) & (leaf_index < tree_size) & (F.size(path) == levels + F.bit_count(above))
    return F.coalesce(F.when(fits, F.aggregate(path, start, step, lambda s: s["hash"] == root)), F.lit(False))


def transfer_size(changes: DataFrame, group: str = "memory_type") -> DataFrame:
    """changes: of diff.  (group, transfer_size, is_empty): how many blocks a reader of the old version must fetch, and whether nothing changed."""
    moved = F.sum((F.col("change") != "unchanged").cast("long"))
    return changes.groupBy(group).agg(F.sum((F.col("change") == "added").cast("long")).alias("transfer_size"), (moved == 0).alias("is_empty"))


def verify_leaves(ids: DataFrame, stored: DataFrame, group: str = "memory_type") -> DataFrame:
    """stored (group, root): (group, n_leaves, n_proven), by a proof of every leaf against the stored root."""
    return verify_packed(packed(ids, group), stored, group)


def verify_packed(rows: DataFrame, stored: DataFrame, group: str = "memory_type") -> DataFrame:
    """verify_leaves of packed rows."""
    held = packed_proofs(rows, group, stored)
    holds = proof_holds(F.col("block_id"), F.col("leaf_index"), F.col("tree_size"), F.col("audit_path"), F.col("root"))
    return held.groupBy(group).agg(F.count(F.lit(1)).alias("n_leaves"), F.sum(holds.cast("long")).alias("n_proven"))


def require_layout(name: str) -> None:
    if name not in LAYOUTS:
        raise LayoutError(f"unknown tree layout {name!r}")


def diff(before: DataFrame, after: DataFrame, group: str = "memory_type") -> DataFrame:
    """(group, block_id, change): added, removed or unchanged."""
    b = before.select(group, "block_id").distinct().withColumn("b", F.lit(True))
    a = after.select(group, "block_id").distinct().withColumn("a", F.lit(True))
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").otherwise("unchanged")
    return b.join(a, [group, "block_id"], "full").select(group, "block_id", change.alias("change"))


LAYOUTS[LAYOUT] = roots
__all__ = [
    "EMPTY_ROOT", "LAYOUTS", "diff", "leaves", "levels", "packed", "packed_proofs", "packed_roots", "proof_holds", "proofs", "require_layout", "roots",
    "transfer_size", "verify_leaves", "verify_packed",
]
