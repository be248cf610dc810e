"""Identity, text and Merkle functions against their definitions in plain Python."""

import glob
import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from lodestone.functions import identity, text
from lodestone.operators import merkle
from lodestone.sources.files import canonical_json


def one(spark, column, **values):
    rows = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return rows.select(column.alias("x")).first().x


def test_canonical_json_of_strings(spark):
    values = ["plain", 'quo"te\\', "tab\tline\n\b\f\r", "ctl\x01\x0b\x1f\x1a", "ünï 中 \U0001f600", "\\u001F stays", "a\\\x1fb", "/\x7f"]
    for v in values:
        want = json.dumps({"a": v}, ensure_ascii=False, separators=(",", ":"))
        assert one(spark, identity.jcs(identity.record(a=F.col("v"))), v=v) == want
        assert canonical_json({"a": v}).decode() == want


def test_absent_optionals_are_dropped(spark):
    payload = identity.record(b=F.lit(None).cast("string"), a=F.lit("x"))
    got = one(spark, identity.envelope("semantic", payload, 1, key="zeta"))
    assert got == '{"memory_type":"semantic","payload":{"a":"x"},"schema_version":1,"serialization":"jcs/1","zeta":1}'


def test_floats_and_large_integers_are_refused(spark):
    kind = spark.sql("SELECT struct(1 AS a, map('k', array(1.5D)) AS b) s").schema["s"].dataType
    with pytest.raises(ValueError, match=r"payload.b.\*\[\]"):
        identity.refuse_non_deterministic(kind)
    for bad in ({"a": 1.0}, {"a": [2**53]}):
        with pytest.raises(ValueError):
            canonical_json(bad)
    assert spark.range(1).select(identity.is_safe_integer(F.lit(2**53 - 1))).first()[0]
    assert not spark.range(1).select(identity.is_safe_integer(F.lit(-(2**53)))).first()[0]


@pytest.mark.parametrize(
    ("value", "good"),
    [("text/plain", True), ("application/vnd.a+json", True), ("Text/plain", False), ("text", False), ("text/plain; q=1", False), ("a/" + "b" * 128, False), ("", False)],
)
def test_media_types(spark, value, good):
    assert one(spark, identity.is_media_type(F.col("v")), v=value) is good


def test_timestamps(spark):
    assert one(spark, identity.utc_timestamp(F.lit("2024-01-02 03:04:05.9").cast("timestamp"))) == "2024-01-02T03:04:05Z"
    for text_, good in (("2024-01-02T03:04:05Z", True), ("2024-01-02 03:04:05", False), ("2024-13-02T03:04:05Z", False)):
        assert (one(spark, identity.parse_timestamp(F.col("v")), v=text_) is not None) is good


def test_decode_errors(spark):
    good = one(spark, identity.envelope("semantic", identity.record(a=F.lit("x")), 1))
    cases = {
        good: None, "nonsense": "not-json", good.replace("lodestone", "other"): "keys", good.replace('"schema_version":1', '"schema_version":9'): "schema-version",
        good.replace("semantic", "episodic"): "memory-type", good.replace(":1,", ": 1,", 1): "not-canonical", good.replace("jcs/1", "jcs/2"): "serialization",
    }
    for raw, want in cases.items():
        assert one(spark, identity.decode_error(F.col("v"), "semantic"), v=raw) == want


def test_stop_words_and_terms():
    assert len(text.STOPWORDS) == 88
    assert text.content_terms("What IS the Straße") == ["strasse"]
    assert text.content_terms("what is it") == ["what", "is", "it"]


def test_stems(spark):
    words = {"removing": "remov", "removes": "remov", "remove": "remov", "uses": "uses", "ties": "ties", "functional": "function", "nationally": "national"}
    words["functional"] = "funct"
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", text.stem(F.col("w")).alias("s"))
    assert {r.w: r.s for r in rows.collect()} == words


@pytest.mark.parametrize(("score", "shown"), [(0.125, "0.12"), (0.375, "0.38"), (1.0, "1.00"), (1 / 3, "0.33")])
def test_scores_round_halves_to_even(spark, score, shown):
    assert one(spark, text.score_text(F.lit(score))) == shown


def mth(leaves):
    """The tree hash by its recursive definition."""
    if not leaves:
        return hashlib.sha256(b"").digest()
    if len(leaves) == 1:
        return hashlib.sha256(b"\0" + leaves[0]).digest()
    k = 1
    while 2 * k < len(leaves):
        k *= 2
    return hashlib.sha256(b"\1" + mth(leaves[:k]) + mth(leaves[k:])).digest()


def test_roots_levels_and_proofs(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK", 2)  # several rounds even for small trees
    sizes = (1, 2, 3, 4, 5, 7, 8, 9, 16, 17)
    groups = {f"g{n}": sorted(hashlib.sha256(f"{n}-{i}".encode()).digest() for i in range(n)) for n in sizes}
    rows = [(g, "sha256:" + x.hex()) for g, own in groups.items() for x in own]
    ids = spark.createDataFrame(rows + rows[:5], "memory_type string, block_id string")
    want = {g: (mth(own).hex(), len(own)) for g, own in groups.items()}
    assert {r.memory_type: (r.root, r.n_blocks) for r in merkle.roots(ids).collect()} == want
    top = merkle.levels(ids).groupBy("memory_type").agg(F.max_by("hash", "level").alias("root"))
    assert {r.memory_type: r.root for r in top.collect()} == {g: w[0] for g, w in want.items()}
    proofs = merkle.proofs(ids).join(merkle.roots(ids), "memory_type")
    column = F.col
    good = merkle.proof_holds(column("block_id"), column("leaf_index"), column("tree_size"), column("audit_path"), column("root"))
    bad = {
        "index": merkle.proof_holds(column("block_id"), column("leaf_index") + column("tree_size"), column("tree_size"), column("audit_path"), column("root")),
        "long": merkle.proof_holds(column("block_id"), column("leaf_index"), column("tree_size"), F.concat("audit_path", F.array("root")), column("root")),
        "block": merkle.proof_holds(F.concat(F.lit("sha256:"), F.sha2("block_id", 256)), column("leaf_index"), column("tree_size"), column("audit_path"), column("root")),
        "root": merkle.proof_holds(column("block_id"), column("leaf_index"), column("tree_size"), column("audit_path"), F.sha2("root", 256)),
    }
    r = proofs.agg(F.count(F.lit(1)).alias("n"), F.count_if(good).alias("good"), *(F.count_if(v).alias(k) for k, v in bad.items())).first()
    assert r.n == r.good == sum(sizes) and [r[k] for k in bad] == [0] * 4
    short = proofs.where("tree_size > 1").select(merkle.proof_holds(column("block_id"), column("leaf_index"), column("tree_size"), F.slice("audit_path", F.lit(1), F.size("audit_path") - 1), column("root")).alias("x"))
    assert short.where("x").count() == 0


@pytest.mark.skipif("GOLDEN_VECTORS" not in os.environ, reason="set GOLDEN_VECTORS to a folder of another implementation's vectors")
def test_golden_vectors(spark):
    read = lambda name: json.load(open(glob.glob(f"{os.environ['GOLDEN_VECTORS']}/{name}.json")[0]))  # noqa: E731, SIM115
    rows = lambda doc: doc if isinstance(doc, list) else next(v for v in doc.values() if isinstance(v, list))
    for v in rows(read("block_ids")):
        assert canonical_json(v["envelope"]).decode() == v["canonical_bytes"]
        assert one(spark, identity.digest(F.col("v")), v=v["canonical_bytes"]) == v["block_id"]
        key = next(k for k in v["envelope"] if k not in ("memory_type", "payload", "schema_version", "serialization"))
        assert one(spark, identity.decode_error(F.col("v"), v["memory_type"], key=key), v=v["canonical_bytes"]) is None
    trees = [(v["name"], b, v["root"]) for v in rows(read("merkle_roots")) for b in v["block_ids"]]
    got = {r.memory_type: r.root for r in merkle.roots(spark.createDataFrame(trees, "memory_type string, block_id string, root string")).collect()}
    assert all("sha256:" + got[n] == r or got[n] == r for n, _, r in trees)
