"""The store end to end: register, commit, search, prove, drop, redact, prune, layers, reconciliation, streams."""

import itertools

import pytest
from pyspark.sql import functions as F

from lodestone.exceptions import (
    AppendOnlyViolation, BlockIntegrityError, DistributionError, LodestoneError, MembershipError, NoCommonAncestor, ReconciliationHalted, ResolutionRefused, RetentionPolicyError,
)
from lodestone.functions.identity import record
from lodestone.operators import reconcile
from lodestone.operators.retention import RetentionPolicy
from lodestone.operators.search import Query
from lodestone.plans import blocks as bl
from lodestone.plans.store import KnowledgeStore
from lodestone.sources import layers

MODEL = {"id": "m", "kind": "model", "version": "1"}


def clock():
    ticks = itertools.count()
    return lambda: f"2026-01-01T00:00:{next(ticks) % 60:02d}Z"


@pytest.fixture
def store(spark, tmp_path):
    policy = RetentionPolicy(canonical_drop_allowed=True, redactable_media_types=("text/plain",))
    return KnowledgeStore(spark, f"file://{tmp_path}/store", clock(), policy)


def sources(spark, *texts):
    return spark.createDataFrame([(bytearray(t.encode()), "text/plain") for t in texts], "bytes binary, media_type string")


def facts(store, cited, *claims, subject="signals"):
    """Candidates (label, statement) that cite blocks."""
    df = store.spark.createDataFrame([(f"c{i}", lab, st) for i, (lab, st) in enumerate(claims)], "candidate string, label string, statement string")
    evidence = F.array(*map(F.lit, cited)) if cited else F.array().cast("array<string>")
    fields = {"kind": F.lit("fact"), "label": F.col("label"), "statement": F.col("statement"), "subject": F.lit(subject)}
    payload = record(**fields, evidence=evidence) if cited else record(**fields)
    rows = bl.build(df, "semantic", payload).select("candidate", "canonical", "memory_type", evidence.alias("cited"))
    return store.propose(rows)


def ids(df):
    return sorted(r.block_id for r in df.select("block_id").collect())


def canonical_ids(store):
    return ids(store.composition().where("memory_type = 'canonical'"))


def test_register_is_idempotent_and_commit_records_derivations(spark, store):
    first = store.register(sources(spark, "source a", "source b", "source a"), normalize=lambda b: F.upper(F.decode(b, "utf-8")))
    assert first and store.register(sources(spark, "source a"), normalize=lambda b: F.upper(F.decode(b, "utf-8"))) is None
    a, b = canonical_ids(store)
    assert store.commit(facts(store, [a], ("fourier", "sums of waves"), ("laplace", "decays")), MODEL)
    assert store.commit(facts(store, [a], ("fourier", "sums of waves")), MODEL) is None  # a duplicate
    assert store.composition().groupBy("memory_type").count().orderBy("memory_type").collect() == [("canonical", 2), ("provenance", 4), ("semantic", 2)]
    assert all(r.root_holds and not r.n_corrupt for r in store.verify().collect())
    statuses = {r.status: r.n for r in store.resolvability().groupBy("status").agg(F.sum("n").alias("n")).collect()}
    assert set(statuses) == {"resolvable"}
    assert len(store.history()) == 2 and store.ancestry() == store.history()
    found = store.search(Query("what is FOURIER waves", subject="signals")).collect()
    assert [(r.score, [s.block_id for s in r.sources]) for r in found] == [("1.00", [a])]
    proof = store.prove(store.composition().where("memory_type = 'semantic'")).collect()
    assert len(proof) == 2 and all(p.root == store.root_of("semantic") for p in proof)


def test_the_gate(spark, store):
    store.register(sources(spark, "text"))
    (a,) = canonical_ids(store)
    store.commit(facts(store, [a], ("x", "one")), MODEL)
    judged = {r.candidate: (r.status, list(r.codes)) for r in store.validate(facts(store, [a], ("x", "two"), ("y", "new"), ("", "none"))).collect()}
    assert judged == {"c0": ("contradicted", ["contradiction"]), "c1": ("validated", []), "c2": ("rejected", ["schema"])}
    missing = store.validate(facts(store, ["sha256:" + "0" * 64], ("z", "new"))).first()
    assert (missing.status, list(missing.codes)) == ("rejected", ["evidence-not-found"])
    assert store.validate(facts(store, [a], ("z", "new")), review=True).first().status == "pending_review"
    assert store.validate(facts(store, [a], ("z", "new")), allowed=("episodic",)).first().status == "rejected"


def test_supersede_demote_and_expand(spark, store):
    store.register(sources(spark, "text"))
    (a,) = canonical_ids(store)
    store.commit(facts(store, [a], ("old", "wave one"), ("new", "wave two"), ("bad", "wave three")), MODEL)
    by = {r.statement: r.block_id for r in bl.decoded(store.blocks()).where("memory_type = 'semantic'").select("p.statement", "block_id").collect()}
    store.supersede(by["wave one"], by["wave two"])
    store.demote([by["wave three"]])
    assert ids(store.search(Query("wave"))) == [by["wave two"]]
    everything = {r.block_id: r.superseded_by for r in store.search(Query("wave", include_superseded=True)).collect()}
    assert everything == {by["wave one"]: by["wave two"], by["wave two"]: None, by["wave three"]: None}
    assert ids(store.search(Query(by["wave two"], mode="exact"))) == [by["wave two"]]
    assert ids(store.search(Query("no digest", mode="exact"))) == []


def test_drop_cascades(spark, store):
    store.register(sources(spark, "wrong", "right"))
    one, two = canonical_ids(store)
    store.commit(facts(store, [one], ("a", "from one")), MODEL)
    store.commit(facts(store, [two], ("b", "from two")), {**MODEL, "version": "2"})
    with pytest.raises(MembershipError):
        store.drop(store._ids(["sha256:" + "0" * 64]), "canonical", "why")
    cautious = KnowledgeStore(spark, store.path, store.clock, RetentionPolicy(canonical_drop_allowed=True, cascade_review_threshold=0))
    assert cautious.drop(store._ids([one]), "canonical", "wrong").review_required
    with pytest.raises(RetentionPolicyError):
        KnowledgeStore(spark, store.path, store.clock).drop(store._ids([one]), "canonical", "wrong")
    result = store.drop(store._ids([one]), "canonical", "wrong")
    assert result.n_dependents == 1 and canonical_ids(store) == [two]
    assert [r.p.statement for r in bl.decoded(store.blocks()).where("memory_type = 'semantic'").collect()] == ["from two"]
    dropped = store.drop_by_producer("model", "m", "2", "bad model")
    assert dropped.snapshot and not dropped.review_required
    assert store.composition().where("memory_type = 'semantic'").count() == 0
    assert store.root_of("semantic") == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert store.prune().count() == 0  # older snapshots still name them
    short = KnowledgeStore(spark, store.path, store.clock, RetentionPolicy(retained_roots=1))
    short.demote([two])
    gone = ids(short.prune(dry_run=False).withColumnRenamed("digest", "block_id"))
    assert one in gone and store.blocks_held().where(F.col("block_id") == one).count() == 0


def test_episodic_is_append_only(spark, store):
    df = spark.createDataFrame([("it rained", "2026-01-01T00:00:00Z")], "summary string, occurred_at string")
    row = bl.build(df, "episodic", record(summary=F.col("summary"), occurred_at=F.col("occurred_at")))
    store.write(row.select("memory_type", "block_id", "schema_version", "canonical"))
    with pytest.raises(RetentionPolicyError):
        store.drop(row.select("block_id"), "episodic", "no")
    empty = store.composition().where("false")
    with pytest.raises(AppendOnlyViolation):
        reconcile.merge(store.composition(), store.composition(), empty.unionByName(spark.createDataFrame([("episodic", "other")], "memory_type string, block_id string")))


def test_redaction_keeps_shared_content(spark, store):
    store.register(sources(spark, "secret"))
    store.register(sources(spark, "secret").withColumn("media_type", F.lit("text/html")))
    first = canonical_ids(store)[0]
    destroyed = ids(store.redact([first], "personal").withColumnRenamed("digest", "block_id"))
    assert destroyed == [first] and store.blobs().count() == 1
    second = [i for i in canonical_ids(store) if i != first]
    assert len(ids(store.redact(second, "personal").withColumnRenamed("digest", "block_id"))) == 2
    assert all(r.root_holds for r in store.verify().collect()) and store.blobs().count() == 0
    assert store.resolvability().where("status = 'tombstoned'").agg(F.sum("n")).first()[0] == 2


def test_layers_round_trip(spark, store, tmp_path):
    store.register(sources(spark, "one", "two"))
    store.commit(facts(store, canonical_ids(store), ("a", "b")), MODEL)
    packed = store.pack()
    assert packed == store.pack()
    with pytest.raises(DistributionError):
        store.pack(("semantic",))
    other = KnowledgeStore(spark, f"file://{tmp_path}/other", clock())
    other.unpack(packed)
    assert all(other.root_of(k) == store.root_of(k) for k in ("canonical", "semantic", "provenance"))
    assert set(other.plan_pull({k: layers.digest(v) for k, v in packed.items()}).values()) == {"reuse"}
    with pytest.raises(DistributionError):
        layers.inflate(layers.pack(b"\0" * (9 << 20), []))
    document, blobs = layers.unpack(packed["canonical"])
    bad = dict.fromkeys(blobs, b"changed")
    with pytest.raises(DistributionError):
        list(layers.entries(layers.pack(document, bad.items())))


@pytest.fixture
def diverged(spark, store, tmp_path):
    """A store and a fork of it, each of which went on alone."""
    store.register(sources(spark, "shared"))
    fork = KnowledgeStore(spark, f"file://{tmp_path}/fork", clock(), store.policy)
    fork.fetch(store)
    fork.files.write("head.json", store.files.read("head.json"))
    (a,) = canonical_ids(store)
    store.commit(facts(store, [a], ("ours", "x")), MODEL)
    return store, fork, a


def test_reconcile_merges_both_sides(spark, diverged):
    store, fork, a = diverged
    fork.commit(facts(fork, [a], ("theirs", "y")), MODEL)
    theirs = store.fetch(fork)
    plan = store.plan_reconcile(theirs)
    assert plan.is_clean and not plan.is_noop
    name = store.reconcile(theirs)
    assert len(store.snapshot(name)["parents"]) == 2 and theirs in store.reachable_history()
    assert {r.p.label for r in bl.decoded(store.blocks()).where("memory_type = 'semantic'").collect()} == {"ours", "theirs"}
    assert store.plan_reconcile(theirs).is_noop
    store.require_fast_forward(theirs)


def test_reconcile_halts_on_contradictions_and_removals(spark, diverged):
    store, fork, a = diverged
    fork.commit(facts(fork, [a], ("ours", "another statement")), MODEL)
    theirs = store.fetch(fork)
    with pytest.raises(ReconciliationHalted):
        store.reconcile(theirs)
    (block,) = [r.candidate for r in store.plan_reconcile(theirs).verdicts.where("status = 'contradicted'").collect()]
    assert store.reconcile_status()["open"] == {block: "contradicted"}
    with pytest.raises(LodestoneError):
        store.demote([a])  # a reconciliation is open
    with pytest.raises(ResolutionRefused):
        store.reconcile_resolve("sha256:" + "0" * 64, "admit")
    with pytest.raises(ReconciliationHalted):
        store.reconcile_continue()
    store.reconcile_abort()
    store.reconcile(theirs, "squash", {block: "reject"})
    assert store.reconcile_status() is None
    assert store.composition().where("memory_type = 'semantic'").count() == 1
    fork.drop(fork._ids([a]), "canonical", "wrong")
    theirs = store.fetch(fork)
    with pytest.raises(ReconciliationHalted):
        store.reconcile(theirs)
    store.reconcile(theirs, accept_removals=True)
    assert store.composition().where("memory_type IN ('canonical', 'semantic')").count() == 0


def test_prefer_and_rebase(spark, diverged):
    store, fork, a = diverged
    fork.commit(facts(fork, [a], ("ours", "another statement")), MODEL)
    theirs = store.fetch(fork)
    ours = store.state()["snapshot"]
    with pytest.raises(ReconciliationHalted):
        store.reconcile(theirs, "rebase")
    (block,) = store.reconcile_status()["open"]
    store.reconcile_resolve(block, "prefer")
    assert [x["fate"] for x in store.attribution(theirs, "rebase")] == ["rewritten"]
    name = store.reconcile_continue()
    assert ids(store.composition().where("memory_type = 'semantic'")) == [block]
    assert store.ancestry(name)[1] == theirs and ours not in store.ancestry(name)
    assert all(r.root_holds for r in store.verify().collect())


def test_reads_are_checked(spark, store, tmp_path):
    store.register(sources(spark, "one", "two"))
    (a, b) = canonical_ids(store)
    digests = spark.createDataFrame([tuple(r) for r in store.blobs().select("digest").collect()], "digest string")
    assert store.get_bytes(digests).count() == 2 and store.get_block("canonical", a).count() == 1
    with pytest.raises(MembershipError):
        store.get_block("semantic", a)
    found = store.search(Query("plain"))
    from lodestone.operators import search

    assert found.count() == 2 and search.all_verified(found) and search.require_verified(found) is found
    assert store.verified_against(Query("x", memory_types=("canonical",))) == {"canonical": store.root_of("canonical")}
    one = digests.limit(1)
    bad = store.blobs().withColumn("bytes", F.encode(F.lit("changed"), "utf-8"))
    store._rewrite("blobs", bad)
    with pytest.raises(BlockIntegrityError):
        store.get_bytes(digests)
    store.delete(one)
    assert store.blobs().count() == 1 and store.has(digests).where("held").count() == 1
    assert store.composition_at(store.state()["snapshot"]).count() == 4
    assert store.without_module("provenance") and store.installed() == ["canonical"] and store.block_count() == 2


def test_snapshots_have_no_folder_names(spark, tmp_path):
    names = []
    for k in range(2):
        own = KnowledgeStore(spark, f"file://{tmp_path}/same{k}", clock())
        names.append(own.register(sources(spark, "same")))
    assert names[0] == names[1]


def test_indices_and_tasks(spark, store, tmp_path):
    from dataclasses import replace

    from lodestone.plans import indices, tasks

    store.register(sources(spark, "text"))
    (a,) = canonical_ids(store)
    store.commit(facts(store, [a], ("fourier", "sums of waves"), ("laplace", "decays")), MODEL)
    best = indices.search(store, indices.INVERTED, "waves", 5).collect()
    assert len(best) == 1 and best[0].score > 0 and indices.search(store, indices.HASHED, "waves", 5).count() >= 1
    before = store.files.names("indices")
    indices.search(store, indices.INVERTED, "decays", 5)
    assert store.files.names("indices") == before  # read, not built again
    indices.dump(store, indices.INVERTED, f"file://{tmp_path}/index")
    rows, manifest = indices.load(spark, indices.INVERTED, f"file://{tmp_path}/index")
    assert rows.count() > 0 and manifest["roots"]["semantic"] == store.root_of("semantic")
    with pytest.raises(indices.IndexMismatch):
        indices.load(spark, replace(indices.INVERTED, model_tag="other"), f"file://{tmp_path}/index")
    assert indices.content_of(store).count() == 1
    found, more = indices.widened(lambda n: indices.search(store, indices.INVERTED, "waves decays", n), store.composition(), 1)
    assert found.count() == 1 and more
    task = tasks.define(store, (a,), ("semantic",), "find facts")
    assert task.task_id == tasks.define(store, (a,), ("semantic",), "find facts").task_id and tasks.sources_of(store, task).count() == 1
    with pytest.raises(ValueError):
        tasks.define(store, (a,), ("canonical",), "no")
    fact = ids(store.composition().where("memory_type = 'semantic'"))[0]
    assert tasks.define_rederivation(store, fact, "again").sources == (a,)


def test_unrelated_histories_have_no_ancestor(spark, store, tmp_path):
    store.register(sources(spark, "a"))
    other = KnowledgeStore(spark, f"file://{tmp_path}/unrelated", clock())
    other.register(sources(spark, "b"))
    with pytest.raises(NoCommonAncestor):
        store.plan_reconcile(store.fetch(other))


def test_rejected_blocks_cannot_be_admitted(spark, diverged):
    store, fork, a = diverged
    broken = facts(fork, ["sha256:" + "0" * 64], ("bad", "evidence"))
    fork.write(broken.select("memory_type", "block_id", F.lit(1).alias("schema_version"), "canonical"))
    theirs = store.fetch(fork)
    (block,) = [r.candidate for r in store.plan_reconcile(theirs).verdicts.where("status = 'rejected'").collect()]
    with pytest.raises(ResolutionRefused):
        store.reconcile(theirs, resolutions={block: "admit"})


def test_stream_registration(spark, store, tmp_path):
    from lodestone.streaming.ingest import register_stream

    folder = f"{tmp_path}/incoming"
    sources(spark, "s1", "s2").write.parquet(folder)
    sources(spark, "s2", "s3").write.mode("append").parquet(folder)
    stream = spark.readStream.schema("bytes binary, media_type string").parquet(folder)
    query = register_stream(store, stream, f"{tmp_path}/checkpoint")
    query.awaitTermination(120)
    assert len(canonical_ids(store)) == 3
