"""Benchmark decontamination (operator 3).

One Aho-Corasick automaton holds every window of the normalised benchmark items; each document is normalised and
scanned once, and hits are mapped back to offsets of the original text.

Normalisation lower-cases A-Z and takes the words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+.  It works on UTF-8 bytes,
one byte to one byte, so a word's place in the normalised bytes is its place in the original ones.

The automaton is the only thing that is broadcast, and its size is checked: the benchmark is dealt to blocks of about
BLOCK_CHARS characters by a hash of the items' texts, and as a window has `width` words, an automaton has at most some
`width` nodes a character, 3 million of about 40 bytes.  A larger benchmark is scanned block after block, each collected
when its turn comes and adding its hits to those found so far.

Defined results: a null or empty text has no words and no hits; an item with a null or wordless text has no window;
an item with a null id marks words as hit but is not counted among the items; repeated items count once; a table
without items marks nothing.  Other columns of either table are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import ALNUM_TABLE, as_bytes, bounded_batches, map_arrow, table

WINDOW = 10
BLOCK_CHARS = 300_000
_built: dict[int, tuple] = {}


def normal_words(raw: bytes | None) -> list[bytes]:
    return raw.translate(ALNUM_TABLE).split() if raw else []


def item_windows(items: list[tuple[str | None, bytes | None]], width: int) -> dict[str, tuple[int, tuple[str, ...]]]:
    """Window text, with a space at either end, to its words and the ids of its items."""
    found: dict[str, tuple[int, set]] = {}
    for item, raw in items:
        words = normal_words(raw)
        k = min(width, len(words))
        for i in range(len(words) - k + 1 if k else 0):
            key = f" {b' '.join(words[i : i + k]).decode('latin-1')} "
            found.setdefault(key, (k, set()))[1].update([item] if item is not None else [])
    return {key: (k, tuple(sorted(ids))) for key, (k, ids) in found.items()}


def automaton(broadcast) -> ahocorasick.Automaton | None:
    """Built once for each Python worker, which keeps the latest one."""
    key = id(broadcast.value)  # held in _built, so the id stays its own
    if key not in _built:
        auto = ahocorasick.Automaton() if broadcast.value else None
        for window, value in broadcast.value.items():
            auto.add_word(window, value)
        if auto is not None:
            auto.make_automaton()
        _built.clear()
        _built[key] = (auto, broadcast.value)
    return _built[key][0]


def find_hits(auto, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
    """Windows' [first, behind last) words, and the items they belong to."""
    norm = b" " + b" ".join(words) + b" "
    spans, items, at, spaces = [], set(), 0, 0
    for end, (k, ids) in auto.iter(norm.decode("latin-1")):
        spaces += norm.count(b" ", at, end + 1)
        at = end + 1
        spans.append((spaces - 1 - k, spaces - 1))
        items.update(ids)
    return spans, items


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def original_spans(raw: bytes, spans: list[list[int]]) -> list[dict]:
    """Word spans to [begin, end) code points of the original text."""
    inside = np.frombuffer(raw.translate(ALNUM_TABLE), np.uint8) != 0x20
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    points = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    return [{"begin": int(points[edges[2 * a]]), "end": int(points[edges[2 * b - 1]])} for a, b in spans]


def benchmark_blocks(benchmark: DataFrame, width: int, block_chars: int) -> tuple[int, Callable[[int], dict]]:
    """How many blocks there are, and the windows of the k-th, which are collected only then."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // block_chars))

    def windows(k: int) -> dict:
        own = items if n == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k)
        return item_windows([(r.item, r.text.encode()) for r in own.collect() if r.text], width)

    return n, windows


SCHEMA = "doc_id long, text string, n_words long, hits array<int>, items array<string>"


def scan(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted as strings), spans (begin and end in the original text)."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<int>").alias("hits"), F.array().cast("array<string>").alias("items"),
    )
    n, windows = benchmark_blocks(benchmark, width, block_chars)
    for k in range(n):
        shared, last = spark.sparkContext.broadcast(windows(k)), k == n - 1

        def step(batch: pa.RecordBatch, shared=shared, last=last) -> list:
            auto, out = automaton(shared), [[] for _ in range(7 if last else 5)]
            raws = as_bytes(batch.column(1))
            hits_so_far, items_so_far = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for i, raw in enumerate(raws):
                words = normal_words(raw)
                spans, items = find_hits(auto, words) if auto is not None and words else ([], set())
                flat = hits_so_far[i]
                spans = merged(spans + list(zip(flat[::2], flat[1::2], strict=True)))
                items = sorted(items.union(items_so_far[i]))
                out[1].append(len(words))
                if last:
                    out[2].append(sum(b - a for a, b in spans))
                    out[3].append(len(items))
                    out[4].append(items)
                    out[5].append(original_spans(raw, spans) if spans else [])
                else:
                    out[2].append([x for s in spans for x in s])
                    out[3].append(items)
            if last:
                return [batch.column(0), *out[1:6]]
            return [batch.column(0), batch.column(1), *out[1:4]]

        if last:
            return map_arrow(
                rows, step,
                "doc_id long, n_words long, n_hit long, n_items long, items array<string>, spans array<struct<begin:int,end:int>>",
            )
        rows = table(map_arrow(rows, step, SCHEMA), "decontaminate")
    raise AssertionError("there is always a block")


def query(spark, sf_dir: str) -> DataFrame:
    from lodestone.llm.common import source

    found = scan(source(spark, sf_dir, "documents"), source(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """docs, with all their columns, without the documents that hold a window of the benchmark.

    A scan without a shuffle: each batch is filtered where it stands.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    at = docs.columns.index("text")
    n, windows = benchmark_blocks(benchmark, width, BLOCK_CHARS)
    for k in range(n):
        shared = spark.sparkContext.broadcast(windows(k))

        def step(batches, shared=shared):
            auto = automaton(shared)
            for batch in batches:
                clean = []
                for raw in as_bytes(batch.column(at)):
                    norm = b" " + b" ".join(normal_words(raw)) + b" "
                    clean.append(auto is None or next(iter(auto.iter(norm.decode("latin-1"))), None) is None)
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(step, docs.schema)
        docs = docs if k == n - 1 else table(docs, "decontaminated")
    return docs


#: Plain SQL for the query: windows by list slices, compared as text.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bk AS (SELECT item, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS t
  FROM (SELECT item, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM bk)),
ks AS (SELECT DISTINCT k FROM win),
dw AS (SELECT rid, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS t
  FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT dw.rid, dw.i, dw.k, win.item FROM dw JOIN win ON dw.k = win.k AND dw.t = win.t),
n1 AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM hit) GROUP BY rid),
n2 AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, item FROM hit WHERE item IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n1 USING (rid) LEFT JOIN n2 USING (rid)
"""
