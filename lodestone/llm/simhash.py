"""SimHash near-dedup (operator 6), with pivot distance tables.

Fingerprints.  Words [^\\x20\\x09-\\x0D]+ of the text with A-Z lower-cased, shingles of k words with repeats,
space-joined; a bit is set if it is in over half of the shingles' hashes.  64 bits: XXH64 with seed 42.  Longer ones,
of the pipeline, start from a hash by words (see shingle_set): further 64-bit words by mixing it with their number.

Links.  Two fingerprints link at `radius` differing bits or fewer.  Equal fingerprints are one class, so copies never
meet.  Between classes:
  * Where they meet.  If 64 bits are cut into b blocks, two fingerprints within radius r agree on b - r blocks at
    least, so each class goes to one bucket for each choice of b - r blocks (exact); b grows with the number of
    classes so that buckets stay small.  Long fingerprints meet in 16-bit bands instead (probabilistic: the chance
    that a pair at 15 % differing bits shares one of 32 bands is 0.9, at 10 % over 0.99).
  * Pivot distance table.  Each class has its Hamming distances to PIVOTS reference fingerprints.  By the triangle
    inequality no pair within r has coordinates that differ by more than r, so a pair with a larger maximum
    difference is discarded; survivors are verified by their own Hamming distance.
  * What leaves a bucket.  Pairs found are joined to groups in place, and a class only sends its link to the smallest
    fingerprint of its group: no more rows than members, however many pairs.
  * Large buckets.  A bucket of more than BUCKET classes is dealt to chunks, and each pair of chunks is a task of its
    own, so no bucket is ever gathered in one task and no pair is lost.
Groups across buckets: see components.

Near copies of the pipeline (keep_one_of_each) are linked by exact Jaccard similarity.  There long fingerprints only
propose pairs; a prefix filter proposes all others that can be similar.  Proposals that cannot reach the similarity by
counts of their shingles in ranges of hashes are discarded, and all others are verified on whole sets.

Defined results: null and empty texts have fingerprint zero and link like any other; repeated rows get the same
result each; component_id is the smallest doc_id that is not null, or null if there is none; other columns are not
looked at.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import as_bytes, bounded_batches, discard, map_arrow, source, table, text_key
from lodestone.llm.components import components

SEED = 42
RADIUS = 4
SHINGLE = 4
PIVOTS = 16
BUCKET = 2048
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = x + _MIX[0]
        x = (x ^ (x >> np.uint64(30))) * _MIX[1]
        x = (x ^ (x >> np.uint64(27))) * _MIX[2]
        return x ^ (x >> np.uint64(31))


def shingle_hashes(raw: bytes | None, shingle: int) -> np.ndarray:
    words = (raw or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    stops = ends[-n:].tolist() if len(words) >= shingle else [int(ends[-1])]
    hash_of = xxhash.xxh64_intdigest
    return np.fromiter((hash_of(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, n)


def shingle_set(raw: bytes | None, shingle: int) -> np.ndarray:
    """Sorted hashes of the different shingles.  A shingle's hash is a polynomial in the XXH64 of its words, mixed, so
    that each word is hashed once and not with every shingle that holds it; it starts from the number of words, which
    tells a text of fewer words from a shingle."""
    words = (raw or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(len(words), shingle)
    n = len(words) - size + 1
    found = np.full(n, size, np.uint64)
    for k in range(size):
        found = found * _MIX[0] + own[k : k + n]  # modulo 2^64
    return np.unique(mixed(found))


def fingerprint(raw: bytes | None, shingle: int, words: int = 1, distinct: bool = False) -> bytes:
    """`words` 64-bit words, little-endian; distinct: each different shingle counts once."""
    hashes = shingle_hashes(raw, shingle)
    return bits_of(np.unique(hashes) if distinct else hashes, words)


def bits_of(hashes: np.ndarray, words: int) -> bytes:
    n = len(hashes)
    if not n:
        return bytes(8 * words)
    counts = np.zeros(64 * words, np.int64)
    for at in range(0, n, 255):
        part = hashes[at : at + 255]
        if words > 1:
            with np.errstate(over="ignore"):
                part = mixed(part[:, None] + np.arange(words, dtype=np.uint64) * _MIX[1])
        bits = np.unpackbits(np.ascontiguousarray(part).view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > n, bitorder="little").tobytes()


def fingerprints(docs: DataFrame, shingle: int, words: int = 1, keep: tuple[str, ...] = ("doc_id",), distinct: bool = False) -> DataFrame:
    """doc_id (and what else is kept), fp: a long, or binary if it has several words."""
    kept = [F.col(c) for c in keep]
    types = dict(docs.dtypes)

    def step(batch: pa.RecordBatch) -> list:
        found = [fingerprint(raw, shingle, words, distinct) for raw in as_bytes(batch.column(batch.num_columns - 1))]
        fp = np.frombuffer(b"".join(found), "<i8") if words == 1 else found
        return [*batch.columns[:-1], fp]

    schema = ", ".join(f"{c} {types[c]}" for c in keep) + (", fp long" if words == 1 else ", fp binary")
    return map_arrow(docs.select(*kept, F.col("text")), step, schema)


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """fps (n, words) uint64 to (n, PIVOTS) distances; the references are fixed pseudo-random fingerprints."""
    words = fps.shape[1]
    pivots = mixed(np.arange(PIVOTS * words, dtype=np.uint64)).reshape(PIVOTS, words)
    return np.stack([np.bitwise_count(fps ^ p).sum(1, dtype=np.int16) for p in pivots], 1)


def linked_pairs(i: np.ndarray, j: np.ndarray, fps: np.ndarray, pivots: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (i, j): discarded by the largest difference of coordinates, survivors verified."""
    for p in range(PIVOTS):
        near = np.abs(pivots[i, p] - pivots[j, p]) <= radius
        i, j = i[near], j[near]
        if not len(i):
            return i, j
    near = np.bitwise_count(fps[i] ^ fps[j]).sum(1, dtype=np.int64) <= radius
    return i[near], j[near]


def smallest_of_group(n: int, pairs: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray | None = None) -> np.ndarray:
    label = np.arange(n) if label is None else label
    i = np.concatenate([p[0] for p in pairs])
    j = np.concatenate([p[1] for p in pairs])
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def bucket_links(keys: np.ndarray, side: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by key, then fingerprint; side 0: all pairs of a bucket; 1 and 2: only pairs between the two sides.
    Returns places (member, smallest of its group) for members that have a group."""
    n = len(keys)
    same = keys[1:] == keys[:-1]
    use = np.zeros(n, bool)
    use[1:] |= same
    use[:-1] |= same
    at = np.flatnonzero(use)
    if not len(at):
        return at, at
    keys, side, own = keys[at], side[at], fps[at]
    pivots = pivot_table(own)
    m, label, found, held = len(at), np.arange(len(at)), [], 0
    i = np.arange(m - 1)
    step = 1
    while len(i):
        i = i[i + step < m]
        i = i[keys[i] == keys[i + step]]  # a bucket is one run, so what ends at this step has ended
        apart = (side[i] == 0) | (side[i] != side[i + step])
        a, b = linked_pairs(i[apart], i[apart] + step, own, pivots, radius)
        if len(a):
            found.append((a, b))
            held += len(a)
        if held > 500_000:
            label, found, held = smallest_of_group(m, found, label), [], 0
        step += 1
    if found:
        label = smallest_of_group(m, found, label)
    member = np.flatnonzero(label != np.arange(m))
    return at[member], at[label[member]]


def block_masks(n_classes: int, radius: int) -> list[int]:
    """A mask of bits for each choice of blocks; more blocks, and so longer keys, for more classes."""
    for blocks in range(radius + 2, radius + 6):
        bits = 64 * (blocks - radius) // blocks
        if 2**bits >= 4 * n_classes:
            break
    edges = [64 * k // blocks for k in range(blocks + 1)]
    own = [((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in range(blocks)]
    return [sum(chosen) for chosen in combinations(own, blocks - radius)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links_in_buckets(keyed: DataFrame, radius: int, words: int, bucket: int = BUCKET) -> DataFrame:
    """keyed: (k1, k2, fp), a row for each bucket that a class is in.  Returns links (a, b) between fingerprints."""
    large = keyed.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket)
    large = large.select("k1", "k2", F.ceil(F.col("n") / bucket).cast("int").alias("chunks"))
    dealt = keyed.join(large, ["k1", "k2"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    chunk = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    tasks = F.when(
        F.col("chunks") > 1,
        F.transform(
            F.sequence(F.lit(0), F.col("chunks") - 1),
            lambda x: F.struct(
                F.least(x, F.col("chunk")).alias("c1"), F.greatest(x, F.col("chunk")).alias("c2"),
                F.when(x == F.col("chunk"), 0).when(F.col("chunk") < x, 1).otherwise(2).alias("side"),
            ),
        ),
    ).otherwise(F.array(F.struct(F.lit(0).alias("c1"), F.lit(0).alias("c2"), F.lit(0).alias("side"))))
    dealt = dealt.withColumn("chunk", chunk).select("k1", "k2", "fp", F.inline(tasks))
    where = ["k1", "k2", "c1", "c2"]
    dealt = dealt.repartition(*where).sortWithinPartitions(*where, "fp").select(
        F.xxhash64(*where).alias("key"), "side", "fp"
    )
    kind = "long" if words == 1 else "binary"

    def run(batches):
        rest = None  # the last bucket may go on in the next batch
        for batch in batches:
            table_ = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            keys = table_.column(0).to_numpy()
            last = int(np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))[-1])
            rest = table_.slice(last)
            yield from links(table_.slice(0, last))
        if rest is not None:
            yield from links(rest)

    def links(rows: pa.Table):
        if rows.num_rows < 2:
            return
        keys, side = rows.column(0).to_numpy(), rows.column(1).to_numpy()
        column = rows.column(2).combine_chunks()
        if words == 1:
            fps = column.to_numpy().view(np.uint64).reshape(-1, 1)
        else:
            fps = np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, words)
        a, b = bucket_links(keys, side, fps, radius)
        if len(a):
            yield pa.RecordBatch.from_arrays([column.take(pa.array(a)), column.take(pa.array(b))], names=["a", "b"])

    return dealt.mapInArrow(run, f"a {kind}, b {kind}")


def grouped(fps: DataFrame, radius: int, words: int = 1, bucket: int = BUCKET) -> DataFrame:
    """fps: a table (doc_id, fp, ...).  Returns (fp, root, component_id), a row for each fingerprint; root is the
    smallest fingerprint of the group."""
    classes = table(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    if words == 1:
        masks = block_masks(classes.count(), radius)
        keys: list[Column] = [
            F.struct(F.lit(k).alias("k1"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("k2")) for k, m in enumerate(masks)
        ]
    else:
        keys = [
            F.struct(F.lit(k).alias("k1"), F.conv(F.hex(F.substring("fp", 2 * k + 1, 2)), 16, 10).cast("long").alias("k2"))
            for k in range(4 * words)
        ]
    keyed = classes.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.k1", "k.k2", "fp")
    roots = components(links_in_buckets(keyed, radius, words, bucket), "fingerprint-links")
    joined = classes.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    joined = table(joined, "fingerprint-roots")
    ids = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    return joined.join(ids, "root").select("fp", "root", "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    docs = source(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    fps = table(fingerprints(docs, SHINGLE), "simhash")
    return fps.join(grouped(fps, RADIUS), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


#: Of the pipeline: five words, each different shingle once, similarity 0.8.  Two sets with Jaccard similarity J and about the same size have
#: cosine 2J/(1+J), and SimHash bits differ with probability arccos(cosine)/pi; one standard deviation is added.
LONG_WORDS = 8
LONG_SHINGLE = 5
SIMILARITY = 0.8


def similarity_radius(similarity: float, words: int) -> int:
    p = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    bits = 64 * words
    return int(bits * p + np.sqrt(bits * p * (1 - p)))


#: Texts from which the order of shingles is learned, and how many shingles of them are known as frequent.  The order
#: decides how many pairs meet, never which of them link.
ORDER_TEXTS, ORDER_SHINGLES = 4096, 200_000


def prefix_length(n: int, similarity: float) -> int:
    """Two sets with that Jaccard similarity share ceil(similarity * n) of either's n members at least, so in any common
    order their first n - ceil(similarity * n) + 1 members share one."""
    return n - math.ceil(similarity * n - 1e-9) + 1 if n else 0


def frequent_shingles(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of the shingles that several texts of a sample share; they come last in prefixes."""
    of = max(1, docs.count() // ORDER_TEXTS)
    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(of)) == 0).select("text")

    def step(batch: pa.RecordBatch) -> list:
        return [np.concatenate([shingle_set(raw, shingle) for raw in as_bytes(batch.column(0))]).view(np.int64)]

    counts = map_arrow(sample, step, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    found = counts.orderBy(F.desc("n"), "key").limit(ORDER_SHINGLES).toArrow()
    keys, n = found.column(0).to_numpy().view(np.uint64), found.column(1).to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


def shingle_sets(docs: DataFrame, shingle: int, similarity: float, words: int) -> DataFrame:
    """doc_id, __t1, __t2, cls (a hash of the set of shingles), n (its size), fp, counts (see counts_of), prefix."""
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, shingle))

    def step(batch: pa.RecordBatch) -> list:
        keys, often = frequent.value
        out: list[list] = [[], [], [], [], []]
        for raw in as_bytes(batch.column(3)):
            own = shingle_set(raw, shingle)
            rank = np.zeros(len(own), np.int64)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                rank = np.where(keys[at] == own, often[at], 0)
            first = own[np.lexsort((own, rank))[: prefix_length(len(own), similarity)]]
            cls = signed(xxhash.xxh64_intdigest(own.tobytes(), SEED))
            for column, value in zip(out, (cls, len(own), bits_of(own, words), counts_of(own), first.view(np.int64)), strict=True):
                column.append(value)
        return [*batch.columns[:-1], *out]

    return map_arrow(
        docs.select("doc_id", "__t1", "__t2", "text"), step,
        "doc_id long, __t1 long, __t2 long, cls long, n int, fp binary, counts binary, prefix array<long>",
    )


PARTS = 256


def counts_of(hashes: np.ndarray) -> bytes:
    """How many hashes of a set are in each of PARTS ranges; the smaller counts of two sets add up to no less than they share."""
    return np.bincount((hashes >> np.uint64(56)).astype(np.int64), minlength=PARTS).astype("<u4").tobytes()


def may_reach(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """Of the pairs (a, b), those whose counts allow that similarity; none that has it is lost."""
    side = lambda k, x: classes.select(F.col("cls").alias(k), F.col("n").alias(f"n_{k}"), F.col("counts").alias(x))
    joined = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")

    def step(batch: pa.RecordBatch) -> list | None:
        x, y = (np.frombuffer(b"".join(as_bytes(batch.column(k))), "<u4").reshape(-1, PARTS) for k in (4, 5))
        both = np.minimum(x, y).sum(1, dtype=np.int64)
        sizes = batch.column(2).to_numpy().astype(np.int64) + batch.column(3).to_numpy()
        keep = pa.array(both >= similarity * (sizes - both) - 1e-9, pa.bool_())
        return [c.filter(keep) for c in batch.columns[:2]]

    return map_arrow(joined.select("a", "b", "n_a", "n_b", "x", "y"), step, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Of the pairs (a, b) of classes, a < b, those with that exact Jaccard similarity of their sets of shingles."""
    pairs = table(may_reach(pairs.select("a", "b").distinct(), classes, similarity), "near-pairs")
    need = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct()
    need = need.join(classes, "cls").select("cls", "text_of.*")
    texts = docs.select("text", "__t1", "__t2").join(need, ["__t1", "__t2"]).groupBy("cls").agg(F.first("text").alias("text"))

    def sets(batch: pa.RecordBatch) -> list:
        return [batch.column(0), [shingle_set(raw, shingle).tobytes() for raw in as_bytes(batch.column(1))]]

    def check(batch: pa.RecordBatch) -> list | None:
        keep = []
        for k, (x, y) in enumerate(zip(as_bytes(batch.column(2)), as_bytes(batch.column(3)), strict=True)):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            if both >= similarity * (len(x) + len(y) - both) - 1e-9:
                keep.append(k)
        return [c.take(pa.array(keep, pa.int64())) for c in batch.columns[:2]] if keep else None

    own = table(map_arrow(texts, sets, "cls long, own binary"), "near-sets")
    joined = pairs.join(own.select(F.col("cls").alias("a"), F.col("own").alias("x")), "a")
    joined = joined.join(own.select(F.col("cls").alias("b"), F.col("own").alias("y")), "b")
    links = table(map_arrow(joined.select("a", "b", "x", "y"), check, "a long, b long"), "near-links")
    discard(pairs)
    discard(own)
    return links


def similar_groups(docs: DataFrame, sets: DataFrame, shingle: int, similarity: float, words: int) -> DataFrame:
    """Returns (node, root) of classes that are linked to others; links have that exact Jaccard similarity, and none is missed.

    Pairs are proposed in three steps, and the later ones leave out what is one group already: by fingerprints (copies
    of one text mostly become one group here, without all their pairs), then each class with the first class of each
    bucket of the prefix filter, then all pairs of these buckets.
    """
    classes = table(
        sets.groupBy("cls").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("counts").alias("counts"), F.min(F.struct("__t1", "__t2")).alias("text_of")),
        "near-classes",
    )
    ordered = lambda df, x, y: df.where(F.col(x) != F.col(y)).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    check = lambda pairs: verified(pairs, docs, classes, shingle, similarity)

    fps = table(classes.where("n > 0").groupBy("fp").agg(F.min("cls").alias("head")), "near-fingerprints")
    keys = [
        F.struct(F.lit(k).alias("k1"), F.conv(F.hex(F.substring("fp", 2 * k + 1, 2)), 16, 10).cast("long").alias("k2"))
        for k in range(4 * words)
    ]
    keyed = fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.k1", "k.k2", "fp")
    met = links_in_buckets(keyed, similarity_radius(similarity, words), words).distinct()
    met = met.join(fps.select(F.col("fp").alias("a"), F.col("head").alias("x")), "a")
    met = met.join(fps.select(F.col("fp").alias("b"), F.col("head").alias("y")), "b")
    same = classes.where("n > 0").join(fps, "fp")
    links = check(ordered(met, "x", "y").union(ordered(same, "cls", "head")))

    held = sets.select("cls", "n", F.explode("prefix").alias("key"))
    shared = held.groupBy("key").agg(F.min("cls").alias("head"), F.max("cls").alias("other")).where("head <> other")
    held = table(held.join(shared.select("key", "head"), "key").distinct(), "near-prefixes")

    def labelled(links: DataFrame) -> DataFrame:
        roots = components(links, "near-groups")
        return held.join(roots, F.col("cls") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cls")).drop("node")

    heads = labelled(links)
    first = heads.where("cls = head").select("key", F.col("n").alias("n1"), F.col("root").alias("root1"))
    close = lambda x, y: F.least(x, y) >= similarity * F.greatest(x, y) - 1e-9
    star = heads.join(first, "key").where((F.col("root") != F.col("root1")) & close("n", "n1"))
    links = table(links.union(check(ordered(star, "cls", "head"))), "near-links")

    rest = labelled(links)
    mixed_keys = rest.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
    rest = table(rest.join(mixed_keys, "key", "left_semi").where("cls <> head"), "near-rest")
    found = pairs_in_buckets(rest, classes, similarity)
    return components(links.union(check(ordered(found, "a", "b"))), "near-groups")


#: Of each class, so many of its smallest keys go with its rows.
FIRST_KEYS = 8


def pairs_in_buckets(rest: DataFrame, classes: DataFrame, similarity: float, bucket: int = BUCKET) -> DataFrame:
    """rest (key, cls, n, root): the pairs (a, b) of one key, of different roots, whose sizes and counts allow that similarity.

    Pairs are compared where a bucket stands and only those that may reach it leave it, so that a bucket of many texts
    that are alike, but not enough, is no product of rows.  A bucket of more than `bucket` classes is dealt to chunks,
    and each pair of chunks is a task of its own.  A pair that meets in many buckets leaves the first: it is passed
    over where both classes have a smaller key among their FIRST_KEYS, as they meet there.  Their smallest common key is
    never passed over; a pair whose smallest one is not among these may leave several buckets.
    """
    last = F.lit(2**63 - 1)  # smaller than no key
    firsts = rest.groupBy("cls").agg(F.array_sort(F.collect_list("key")).alias("keys")).select(
        "cls", F.slice(F.concat(F.slice("keys", 1, FIRST_KEYS), F.array_repeat(last, FIRST_KEYS)), 1, FIRST_KEYS).alias("firsts")
    )
    large = rest.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > bucket)
    large = large.select("key", F.ceil(F.col("size") / bucket).cast("int").alias("chunks"))
    dealt = rest.join(large, "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int"))
    tasks = F.transform(
        F.sequence(F.lit(0), F.col("chunks") - 1),
        lambda x: F.struct(
            F.least(x, F.col("chunk")).alias("c1"), F.greatest(x, F.col("chunk")).alias("c2"),
            F.when(x == F.col("chunk"), 0).when(F.col("chunk") < x, 1).otherwise(2).alias("side"),
        ),
    )
    dealt = dealt.join(firsts, "cls").join(classes.select("cls", "counts"), "cls")
    dealt = dealt.select("key", "cls", "n", "root", "counts", "firsts", F.inline(tasks))
    where = ["key", "c1", "c2"]
    dealt = dealt.repartition(*where).sortWithinPartitions(*where, "n", "cls").select(
        F.xxhash64(*where).alias("task"), "side", "cls", "n", "root", "counts", "key", "firsts"
    )

    def run(batches):
        rest_ = None  # the last bucket may go on in the next batch
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if rest_ is None else pa.concat_tables([rest_, rows])
            task = rows.column(0).to_numpy()
            last = int(np.flatnonzero(np.concatenate(([True], task[1:] != task[:-1])))[-1])
            rest_ = rows.slice(last)
            yield from compare(rows.slice(0, last))
        if rest_ is not None:
            yield from compare(rest_)

    def compare(rows: pa.Table):
        if rows.num_rows < 2:
            return
        task, side, cls, n, root = (rows.column(k).to_numpy() for k in range(5))
        n = n.astype(np.int64)
        counts = np.frombuffer(b"".join(as_bytes(rows.column(5).combine_chunks())), "<u4").reshape(-1, PARTS)
        key = rows.column(6).to_numpy()
        firsts = rows.column(7).combine_chunks().flatten().to_numpy().reshape(-1, FIRST_KEYS)
        i, step = np.arange(len(task) - 1), 1
        while len(i):
            i = i[i + step < len(task)]
            i = i[(task[i] == task[i + step]) & (n[i] >= similarity * n[i + step] - 1e-9)]  # sizes rise, so later ones are no closer
            at = i[(root[i] != root[i + step]) & (cls[i] != cls[i + step]) & ((side[i] == 0) | (side[i] != side[i + step]))]
            for part in np.array_split(at, len(at) // 10_000 + 1):
                own = firsts[part][:, :, None]
                met = ((own == firsts[part + step][:, None, :]) & (own < key[part, None, None])).any((1, 2))
                part = part[~met]
                both = np.minimum(counts[part], counts[part + step]).sum(1, dtype=np.int64)
                part = part[both >= similarity * (n[part] + n[part + step] - both) - 1e-9]
                if len(part):
                    yield pa.RecordBatch.from_arrays([pa.array(cls[part]), pa.array(cls[part + step])], names=["a", "b"])
            step += 1

    bounded_batches(rest.sparkSession)
    return dealt.mapInArrow(run, "a long, b long")


def keep_one_of_each(docs: DataFrame, shingle: int = LONG_SHINGLE, similarity: float = SIMILARITY, words: int = LONG_WORDS) -> DataFrame:
    """docs, with all their columns, with one document (the smallest doc_id) of each group of near duplicates: texts
    are linked by the exact Jaccard similarity of their sets of shingles, and links are closed transitively.

    Wordless texts are one group.  Of rows with the same doc_id and text one stays.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *text_key(F.col("text")))
    sets = table(shingle_sets(keyed, shingle, similarity, words), "shingle-sets")
    roots = similar_groups(keyed, sets, shingle, similarity, words)
    fps = sets.select("doc_id", "__t1", "__t2", "cls")
    groups = fps.join(roots, F.col("cls") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cls"))
    first = groups.groupBy("root").agg(F.min(F.struct("doc_id", "__t1", "__t2")).alias("first"))
    stays = table(first.select(F.col("first.doc_id").alias("__id"), F.col("first.__t1").alias("__u1"), F.col("first.__t2").alias("__u2")), "stays")
    # the columns travel under numbers, so that none of their names can clash with those of the join
    names = docs.columns
    own = docs.select(
        *(F.col(f"`{c}`").alias(f"__c{k}") for k, c in enumerate(names)), F.col("doc_id").cast("long").alias("__doc"), *text_key(F.col("text"))
    )
    kept = own.join(
        stays, (F.col("__t1") == F.col("__u1")) & (F.col("__t2") == F.col("__u2")) & F.col("__doc").eqNullSafe(F.col("__id")), "left_semi"
    )
    repeated = fps.groupBy("doc_id", "__t1", "__t2").count().where("count > 1")
    if not repeated.isEmpty():
        kept = kept.dropDuplicates(["__doc", "__t1", "__t2"])
    return kept.select(*(F.col(f"__c{k}").alias(c) for k, c in enumerate(names)))
