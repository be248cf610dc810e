"""What large modules need: paths that are not moved, and walks as long as the proof."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lodestone.operators import composition, merkle
from lodestone.queries import QUERIES


def ids_of(spark, n, group="episodic"):
    hexes = [hashlib.sha256(f"{group}{i}".encode()).hexdigest() for i in range(n)]
    return spark.createDataFrame([(group, f"sha256:{h}") for h in hexes], "memory_type string, block_id string")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def above_explode(df):
    """The lines of the plan over the last explode."""
    return plan(df).split("Generate ")[0]


def test_one_leaf_has_one_index(spark):
    h = hashlib.sha256(b"x").hexdigest()
    root = hashlib.sha256(b"\0" + bytes.fromhex(h)).hexdigest()
    tries = spark.createDataFrame([(i,) for i in (-2, -1, 0, 1)], "i long")
    holds = merkle.proof_holds(F.lit(f"sha256:{h}"), F.col("i"), F.lit(1), F.array().cast("array<string>"), F.lit(root))
    assert {r.i for r in tries.where(holds).collect()} == {0}


def test_proofs_are_not_moved_to_be_verified(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK", 2)
    rows = merkle.packed(ids_of(spark, 40))
    found = merkle.packed_proofs(rows, beside=merkle.packed_roots(rows))
    assert "Exchange" not in above_explode(found) and "Join" not in above_explode(found)
    holds = merkle.proof_holds(F.col("block_id"), F.col("leaf_index"), F.col("tree_size"), F.col("audit_path"), F.col("root"))
    other = merkle.proof_holds(F.col("block_id"), F.col("leaf_index").bitwiseXOR(F.lit(1)), F.col("tree_size"), F.col("audit_path"), F.col("root"))
    assert found.where(holds).count() == 40 and found.where(other).count() == 0


def test_ids_that_are_no_digests_are_refused(spark):
    with pytest.raises(Exception, match="not a digest"):
        merkle.packed(ids_of(spark, 3).union(spark.createDataFrame([("episodic", "sha256:XY")], "a string, b string")))


def test_document_digests_equal_those_of_whole_documents(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK", 2)
    ids = ids_of(spark, 23).union(ids_of(spark, 1, "semantic")).union(ids_of(spark, 4, "canonical")).union(ids_of(spark, 2))
    whole = composition.document(ids, 'a"ü/1').select("memory_type", F.sha2("document", 256).alias("document_sha256"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")  # modules begin inside batches and span them
    try:
        found = composition.document_digests(ids, 'a"ü/1').collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == 3 and set(map(tuple, found)) == set(map(tuple, whole.collect()))
    assert composition.document_digests(ids.where("false"), "x").count() == 0


def test_no_row_holds_a_module(spark):
    assert "collect_list" not in plan(QUERIES["composition_document"](spark, "/root/testdata/sf0.001"))


@pytest.mark.parametrize(("name", "moves"), [("inclusion_proof_paths", 0), ("merkle_verify_leaves", 1)])
def test_paths_of_queries_are_not_moved(spark, name, moves):
    over = above_explode(QUERIES[name](spark, "/root/testdata/sf0.001"))  # verification moves its sums of each module once
    assert over.count("Exchange") == moves and "Join" not in over
