"""Sets of block ids: (memory_type, block_id) tables and their algebra."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.exceptions import AppendOnlyViolation

KEY = ["memory_type", "block_id"]


def add(composition: DataFrame, ids: DataFrame) -> DataFrame:
    return composition.select(*KEY).unionByName(ids.select(*KEY)).distinct()


def drop(composition: DataFrame, ids: DataFrame) -> DataFrame:
    """The composition without ids; refused if one of them is in the episodic module."""
    if not ids.where(F.col("memory_type") == "episodic").isEmpty():
        raise AppendOnlyViolation("the episodic module is append-only")
    return composition.select(*KEY).distinct().join(ids.select(*KEY), KEY, "left_anti")


def contains(composition: DataFrame, ids: DataFrame) -> DataFrame:
    return ids.join(composition.select(*KEY).distinct(), KEY, "left_semi")


def document(composition: DataFrame, layout: str) -> DataFrame:
    """(memory_type, document): the canonical JSON of each module's sorted ids.

    A document is one object by definition, so its module's ids are gathered; tables above never need it.  For the digest
    of a large one see document_digests.
    """
    from lodestone.functions.identity import jcs, record

    own = composition.select(*KEY).distinct().groupBy("memory_type").agg(F.array_sort(F.collect_list("block_id")).alias("ids"))
    return own.select(
        "memory_type",
        jcs(record(block_ids=F.col("ids"), layout=F.lit(layout), memory_type=F.col("memory_type"), version=F.lit(1))).alias("document"),
    )


def document_digests(composition: DataFrame, layout: str) -> DataFrame:
    """(memory_type, document_sha256): the SHA-256 of each module's document, which itself is never gathered.

    A hash takes its text in order, so one task a module reads it; but ids come sorted, as rows of bounded size, and leave
    their row before they are handed to Python in Arrow batches.  No SQL expression hashes a stream.
    """
    from lodestone.operators.merkle import packed

    rows = packed(composition).repartition("memory_type").sortWithinPartitions("memory_type", "block")
    ids = rows.select("memory_type", F.explode("own").alias("id"))
    return ids.mapInArrow(_hashed(layout), "memory_type string, document_sha256 string")


def _hashed(layout: str):
    def hashed(batches):
        import hashlib
        import json

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def end():
            rest = json.dumps({"layout": layout, "memory_type": module, "version": 1}, ensure_ascii=False, separators=(",", ":"))
            own.update(("]," + rest[1:]).encode())
            return pa.RecordBatch.from_pydict({"memory_type": [module], "document_sha256": [own.hexdigest()]})

        module, own = None, None
        for batch in batches:
            runs = pc.run_end_encode(batch.column(0))
            start = 0
            for name, stop in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                if name != module:
                    if own is not None:
                        yield end()
                    module, own = name, hashlib.sha256(b'{"block_ids":[')
                    first = True
                raw = b"".join(batch.column(1).slice(start, stop - start).to_pylist())
                text = np.empty((stop - start, 74), np.uint8)  # ,"sha256:<hex>"
                text[:, :9] = np.frombuffer(b',"sha256:', np.uint8)
                text[:, 9:73] = np.frombuffer(raw.hex().encode(), np.uint8).reshape(-1, 64)
                text[:, 73] = ord('"')
                own.update(text.tobytes()[first:])
                start, first = stop, False
        if own is not None:
            yield end()

    return hashed


def from_document(documents: DataFrame) -> DataFrame:
    kind = "block_ids array<string>, memory_type string"
    parsed = documents.select(F.from_json("document", kind).alias("d"))
    return parsed.select(F.col("d.memory_type").alias("memory_type"), F.explode("d.block_ids").alias("block_id"))
