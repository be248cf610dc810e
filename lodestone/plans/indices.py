"""Indices as derived tables of a store: built for a module's root, kept until the root changes.

An index has a kind, a model tag and a build, a function from texts (block_id, text) to a table; search takes that table
and a query.  A built table lies in the store's folder under its kind, model tag and the roots it was built from, so a
store whose modules did not change reads it again, and one whose modules did builds anew.  An index that travels is
exported with its manifest, and is refused by an index with another model tag.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.exceptions import LodestoneError
from lodestone.operators import ranking
from lodestone.plans import blocks as bl
from lodestone.sources.files import Files, canonical_json


class IndexMismatch(LodestoneError):
    """A stored index was made by another kind or model."""


@dataclass(frozen=True)
class Index:
    kind: str
    model_tag: str
    build: Callable[[DataFrame], DataFrame]
    search: Callable[[DataFrame, int, str], DataFrame]
    rebuildable: bool = True


def _postings_search(table: DataFrame, n_blocks: int, text: str) -> DataFrame:
    return ranking.idf_search(table, n_blocks, ranking.query_tokens(table.sparkSession, text))


def _vector_search(table: DataFrame, n_blocks: int, text: str) -> DataFrame:
    one = table.sparkSession.createDataFrame([("q", text)], "block_id string, text string")
    return ranking.vector_search(table, ranking.hashed_vectors(one))


INVERTED = Index("inverted", "stems/1", ranking.postings, _postings_search)
HASHED = Index("hashed-vectors", f"sha256-{ranking.DIMENSIONS}/1", ranking.hashed_vectors, _vector_search)


def texts_of(store, memory_types: tuple[str, ...] = ("semantic", "procedural")) -> DataFrame:
    """(block_id, text): searchable text of the modules' blocks, with that of text content that they name."""
    return bl.views(store.blocks().where(F.col("memory_type").isin(*memory_types))).select("block_id", F.col("haystack").alias("text"))


def content_of(store, memory_types: tuple[str, ...] = ("canonical",)) -> DataFrame:
    """(block_id, digest, bytes): the content that blocks name, for indices over it."""
    named = bl.content_of(store.blocks().where(F.col("memory_type").isin(*memory_types)))
    return named.select("block_id", F.explode("content").alias("digest")).join(store.blobs().select("digest", "bytes"), "digest")


def _manifest(index: Index, roots: dict[str, str], n_blocks: int) -> dict:
    return {"kind": index.kind, "model_tag": index.model_tag, "roots": roots, "block_count": n_blocks}


def open_index(store, index: Index, memory_types: tuple[str, ...] = ("semantic", "procedural")) -> tuple[DataFrame, int]:
    """The index's table for the head's roots, and the number of blocks; built only if it is not there."""
    modules = store.snapshot()["modules"]
    roots = {k: modules[k]["root"] for k in memory_types if k in modules}
    n_blocks = sum(modules[k]["block_count"] for k in roots)
    name = hashlib.sha256(canonical_json(_manifest(index, roots, n_blocks))).hexdigest()
    folder = f"indices/{index.kind}-{name}"
    if not store.files.exists(f"{folder}/manifest.json"):
        if not index.rebuildable:
            raise LodestoneError(f"the index {index.kind} cannot be built here; import one that was vouched for")
        index.build(texts_of(store, memory_types)).write.mode("overwrite").parquet(f"{store.path}/{folder}/rows")
        store.files.write(f"{folder}/manifest.json", canonical_json(_manifest(index, roots, n_blocks)))
    return store.spark.read.parquet(f"{store.path}/{folder}/rows"), n_blocks


def search(store, index: Index, text: str, limit: int) -> DataFrame:
    """(block_id, score), best first."""
    table, n_blocks = open_index(store, index)
    return index.search(table, n_blocks, text).orderBy(F.desc("score"), "block_id").limit(limit)


def dump(store, index: Index, path: str) -> None:
    """The index as a folder of its own: rows, then the manifest that says whose they are."""
    table, n_blocks = open_index(store, index)
    modules = store.snapshot()["modules"]
    roots = {k: modules[k]["root"] for k in ("semantic", "procedural") if k in modules}
    table.write.mode("overwrite").parquet(f"{path}/rows")
    Files(store.spark, path).write("manifest.json", canonical_json(_manifest(index, roots, n_blocks)))


def load(spark, index: Index, path: str) -> tuple[DataFrame, dict]:
    """The rows and the manifest of a dumped index; refused if it is of another kind or model."""
    manifest = Files(spark, path).read_json("manifest.json")
    if manifest is None or (manifest["kind"], manifest["model_tag"]) != (index.kind, index.model_tag):
        raise IndexMismatch(f"the index at {path} is not {index.kind} of {index.model_tag}")
    return spark.read.parquet(f"{path}/rows"), manifest


def widened(ranking_of: Callable[[int], DataFrame], eligible: DataFrame, limit: int) -> tuple[DataFrame, bool]:
    """ranking_of: pool size to the best so many.  The best `limit` eligible rows and whether more may follow; the pool
    doubles until enough of it is eligible or it has no more rows."""
    pool = max(ranking.POOL_FACTOR * limit, ranking.POOL_LEAST)
    while True:
        found = ranking_of(pool)
        n = found.count()
        own = found.join(eligible.select("block_id"), "block_id", "left_semi")
        if n < pool or own.count() > limit:
            return own.orderBy(F.desc("score"), "block_id").limit(limit), own.count() > limit or n >= pool
        pool *= 2
