"""Line dedup (operator 10): levelled sorted runs of line hashes.

A run is a table of (h1, h2, n, owner) sorted by the 128-bit hash of a line's key: in how many documents of its
batches the line stands, and the smallest doc_id that holds it.  Each new batch is merged against the runs: lines
which they already know as frequent are anti-joined away, and what is left becomes a run of level 0.  When a level
has `fanout` runs, they are merged into one run of the next level.  So a line's hash is rewritten at most once a
level, and a batch reads hashes only, never older texts.

A second pass drops lines: a document's distinct line hashes are joined with the frequent ones, and what was hit
goes back to the document by (doc_id, 128-bit hash of the text).  Only then does a text move, once.  Joins have no
hint, so that Spark broadcasts a side only where its measured size allows it, and splits hot keys otherwise.

A key is the line without [\\x20\\x09-\\x0D] at its ends and with A-Z lower-cased.

Defined results: a null or empty text is one empty line with an empty key, which is shorter than min_chars=1 and
stays; repeated rows are documents of their own, each counting once; of rows with the same doc_id and text each gets
the same result; with keep_first the owner keeps its line, and a null doc_id never is the owner.  Extra columns stay
as they are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructType

from lodestone.llm.common import as_bytes, map_arrow, source, table, text_key

MIN_DOCS = 10
MIN_CHARS = 1
BATCHES = 4
FANOUT = 3
_STRIP = b" \t\n\x0b\x0c\r"
_KEY = ["h1", "h2"]


def line_keys(raw: bytes | None, min_chars: int) -> list[bytes]:
    """The digest of each line's key; empty for a key that is too short."""
    out = []
    for line in (raw or b"").split(b"\n"):
        key = line.strip(_STRIP).lower()
        long_enough = len(key) >= min_chars and (min_chars <= 1 or len(key.decode(errors="replace")) >= min_chars)
        out.append(xxhash.xxh3_128_digest(key) if long_enough else b"")
    return out


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def document_lines(docs: DataFrame, min_chars: int, keys: bool = False) -> DataFrame:
    """A row for each distinct line of a document: doc_id, h1, h2; with keys, also the text's own two hashes."""
    own = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text")]
    own += text_key(F.col("text")) if keys else []

    def step(batch: pa.RecordBatch) -> list | None:
        at, digests = [], []
        for i, raw in enumerate(as_bytes(batch.column(1))):
            distinct = dict.fromkeys(line_keys(raw, min_chars))
            distinct.pop(b"", None)
            digests += distinct
            at.append(len(distinct))
        if not digests:
            return None
        rows = pa.array(np.repeat(np.arange(batch.num_rows), at))
        return [batch.column(0).take(rows), *_halves(digests), *(batch.column(k).take(rows) for k in (2, 3) if keys)]

    return map_arrow(
        docs.select(*own), step, "doc_id long, h1 long, h2 long" + ", __t1 long, __t2 long" * keys
    )


class LineRuns:
    """The runs, by level.  Each is a Parquet table in the shared folder."""

    def __init__(self, min_docs: int = MIN_DOCS, fanout: int = FANOUT):
        self.min_docs, self.fanout = min_docs, fanout
        self.levels: list[list[DataFrame]] = [[]]

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    @staticmethod
    def _merge(runs: list[DataFrame]) -> DataFrame:
        every = runs[0]
        for run in runs[1:]:
            every = every.unionByName(run)
        if len(runs) == 1:
            return every
        return every.groupBy(*_KEY).agg(F.sum("n").alias("n"), F.min("owner").alias("owner"))

    def absorb(self, batch: DataFrame) -> None:
        """batch: (h1, h2, n, owner), a row for each line.  Known frequent lines are dropped, but for those that the batch
        has in a document with a smaller doc_id; the others are a new run."""
        if held := self.runs():
            known = self._merge(held).where(F.col("n") >= self.min_docs).select(*_KEY, F.col("owner").alias("first"))
            known_as = F.coalesce(F.col("owner") >= F.col("first"), F.col("owner").isNull())
            batch = batch.join(known.withColumn("known", F.lit(True)), _KEY, "left")
            batch = batch.where(F.col("known").isNull() | ~known_as).select(*_KEY, "n", "owner")
        self.levels[0].append(self._write(batch, 0))
        for k, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(self._write(self._merge(level), k + 1))
                level.clear()

    @staticmethod
    def _write(rows: DataFrame, level: int) -> DataFrame:
        return table(rows.sortWithinPartitions(*_KEY), f"line-run-{level}")

    def frequent(self) -> DataFrame:
        """h1, h2, owner of the lines found in min_docs documents or more."""
        return self._merge(self.runs()).where(F.col("n") >= self.min_docs).select(*_KEY, "owner")


def build_runs(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES) -> LineRuns:
    """Takes docs as so many batches in turn, all of them; one scan counts each batch's lines by itself."""
    lines = document_lines(docs, min_chars).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int"))
    counted = lines.groupBy("batch", *_KEY).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("owner"))
    counted = table(counted, "line-batches", ("batch",))
    runs = LineRuns(min_docs)
    for k in range(batches):
        runs.absorb(counted.where(F.col("batch") == k).drop("batch"))
    return runs


def cut(docs: DataFrame, runs: LineRuns, min_chars: int = MIN_CHARS, keep_first: bool = False) -> DataFrame:
    """docs without the frequent lines, with columns __n_lines and __n_dropped; a text without dropped lines stays as it is."""
    hits = document_lines(docs, min_chars, keys=True).join(runs.frequent(), _KEY)
    if keep_first:
        hits = hits.where(~F.col("doc_id").eqNullSafe(F.col("owner")))
    drops = hits.groupBy("doc_id", "__t1", "__t2").agg(F.collect_set(F.struct(*_KEY)).alias("__drops"))
    drops = drops.select(F.col("doc_id").alias("__id"), F.col("__t1").alias("__u1"), F.col("__t2").alias("__u2"), "__drops")
    # the columns travel under numbers, so that none of their names can clash with those of the join
    names = docs.columns
    keyed = docs.select(
        *(F.col(f"`{c}`").alias(f"__c{k}") for k, c in enumerate(names)), F.col("doc_id").alias("__doc"), *text_key(F.col("text"))
    )
    joined = keyed.join(
        drops,
        (F.col("__t1") == F.col("__u1")) & (F.col("__t2") == F.col("__u2")) & F.col("__doc").eqNullSafe(F.col("__id")),
        "left",
    ).select(*(f"__c{k}" for k in range(len(names))), "__drops")
    at = names.index("text")
    out = StructType([*docs.schema.fields]).add("__n_lines", LongType()).add("__n_dropped", LongType())
    schema = to_arrow_schema(out)

    def step(batches):
        for batch in batches:
            drops = batch.column(len(names))
            lists = drops.flatten()
            pairs = np.stack([lists.field(k).to_numpy(zero_copy_only=False) for k in (0, 1)], 1).astype("<i8").tobytes()
            sizes = np.asarray(drops.value_lengths().fill_null(0)).tolist()
            texts, n_lines, n_dropped, begin = [], [], [], 0
            for raw, size in zip(as_bytes(batch.column(at)), sizes, strict=True):
                if not size:
                    texts.append(raw)
                    n_lines.append((raw or b"").count(b"\n") + 1)
                    n_dropped.append(0)
                    continue
                gone = {pairs[16 * k : 16 * k + 16] for k in range(begin, begin + size)}
                begin += size
                lines = raw.split(b"\n")
                kept = [x for x, key in zip(lines, line_keys(raw, min_chars), strict=True) if key not in gone]
                texts.append(b"\n".join(kept))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
            text = pa.array(texts, pa.binary()).cast(pa.string())
            columns = [batch.column(k) if k != at else text for k in range(len(names))]
            arrays = [*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(arrays, schema, strict=True)], schema=schema)

    return joined.mapInArrow(step, out)


def query(spark, sf_dir: str) -> DataFrame:
    docs = source(spark, sf_dir, "documents").select("doc_id", "text")
    kept = cut(docs, build_runs(docs))
    return kept.select(
        "doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"),
        F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256"),
    )


def brute_force(rows: list[tuple[int | None, str | None]], min_docs: int = MIN_DOCS) -> list[tuple]:
    """The same, a row at a time; for tests."""
    keys = [[x.strip(_STRIP).lower() for x in (t or "").encode().split(b"\n")] for _, t in rows]
    seen: dict[bytes, int] = {}
    for own in keys:
        for key in set(own):
            seen[key] = seen.get(key, 0) + 1
    out = []
    for (doc, text), own in zip(rows, keys, strict=True):
        lines = (text or "").encode().split(b"\n")
        kept = [x for x, key in zip(lines, own, strict=True) if not key or seen[key] < min_docs]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256(b"\n".join(kept)).hexdigest()))
    return out


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM d),
k AS (SELECT rid, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rid) >= 10),
m AS (SELECT rid, pos, line, f.key IS NOT NULL AS gone FROM k LEFT JOIN f USING (key)),
g AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept FROM m GROUP BY rid)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_dropped AS BIGINT) AS n_dropped, sha256(kept) AS kept_sha256
FROM d JOIN g USING (rid)
"""
