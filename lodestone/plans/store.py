"""A versioned knowledge store over Parquet: the public API.

Tables under the store's folder: blocks (append-only, partitioned by memory_type), blobs, tombstones, and for each
module version its membership.  Snapshots are small JSON documents named by their digest; the head is a pointer that
is replaced last, so a reader sees the old state or the new one.  There is one writer at a time.  Everything that
grows with the data is a DataFrame; only snapshots, roots and pointers come to the driver.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.exceptions import (
    BlockIntegrityError, DistributionError, DivergenceError, LodestoneError, MembershipError, NoCommonAncestor, ReconciliationHalted, ResolutionRefused, SnapshotError,
)
from lodestone.functions.identity import ENVELOPE_KEY, MEMORY_TYPES, VERSION, digest, record
from lodestone.operators import composition, graph, ledger, merkle
from lodestone.operators import reconcile as merging
from lodestone.operators import search as retrieval
from lodestone.operators import validate as gate
from lodestone.operators.retention import RetentionPolicy, content_named, mark, redactable, sweep
from lodestone.plans import blocks as bl
from lodestone.plans.scratch import checkpointed
from lodestone.sources import layers
from lodestone.sources.files import Files, canonical_json

ACTOR = {"id": "lodestone", "kind": "service"}
KEY = ["memory_type", "block_id"]
IDS = "memory_type string, block_id string"


def utc_now() -> str:
    return time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())


@dataclass(frozen=True)
class DropResult:
    review_required: bool
    snapshot: str | None
    n_dependents: int


@dataclass(frozen=True)
class ReconcilePlan:
    base: str
    merged: DataFrame
    withdrawn: DataFrame
    verdicts: DataFrame
    is_clean: bool
    is_noop: bool


class KnowledgeStore:
    def __init__(self, spark: SparkSession, path: str, clock: Callable[[], str] = utc_now, policy: RetentionPolicy | None = None):
        self.spark, self.path, self.clock = spark, path.rstrip("/"), clock
        self.policy = policy or RetentionPolicy()
        self.files = Files(spark, self.path)

    # --- tables -----------------------------------------------------------------------------------------------------

    def _folder(self, name: str) -> str:
        """The folder that holds a table now; a rewrite makes a new one and then moves the pointer."""
        return (self.files.read_json("tables.json") or {}).get(name, name)

    def _table(self, name: str, schema: str) -> DataFrame:
        reader, folder = self.spark.read.schema(schema), self._folder(name)
        return reader.parquet(f"{self.path}/{folder}") if self.files.exists(folder) else self.spark.createDataFrame([], schema)

    def blocks_held(self) -> DataFrame:
        return self._table("blocks", "block_id string, schema_version int, canonical string, memory_type string").select(
            "memory_type", "block_id", "schema_version", "canonical"
        ).join(self.tombstones().select(F.col("digest").alias("block_id")), "block_id", "left_anti")

    def blobs(self) -> DataFrame:
        held = self._table("blobs", "digest string, bytes binary, size long")
        return held.join(self.tombstones().select("digest"), "digest", "left_anti")

    def tombstones(self) -> DataFrame:
        return self._table("tombstones", "digest string, reason string")

    def put_bytes(self, rows: DataFrame) -> DataFrame:
        """rows (bytes): stored once for each digest.  Returns them with digest and size."""
        named = rows.withColumns({"digest": digest(F.col("bytes")), "size": F.octet_length("bytes").cast("long")})
        held = self._table("blobs", "digest string, bytes binary, size long").select("digest")
        new = named.select("digest", "bytes", "size").dropDuplicates(["digest"]).join(held, "digest", "left_anti")
        checkpointed(new).write.mode("append").parquet(f"{self.path}/{self._folder('blobs')}")
        return named

    def get_bytes(self, digests: DataFrame) -> DataFrame:
        """digests (digest): (digest, bytes) of those that are held; refused if bytes do not hash to their digest."""
        found = checkpointed(self.blobs().join(digests.select("digest").distinct(), "digest", "left_semi"))
        bad = [r.digest for r in found.where(digest(F.col("bytes")) != F.col("digest")).select("digest").limit(5).collect()]
        if bad:
            raise BlockIntegrityError(f"bytes do not hash to {', '.join(bad)}")
        return found.select("digest", "bytes")

    def has(self, digests: DataFrame) -> DataFrame:
        """digests (digest), each once, with held: whether there are bytes or a tombstone."""
        known = self.iter_digests().unionByName(self.tombstones().select("digest")).distinct().withColumn("held", F.lit(True))
        return digests.select("digest").distinct().join(known, "digest", "left").select("digest", F.coalesce("held", F.lit(False)).alias("held"))

    def iter_digests(self) -> DataFrame:
        """Everything that has bytes: blocks and content, without tombstones."""
        return self.blocks_held().select(F.col("block_id").alias("digest")).unionByName(self.blobs().select("digest")).distinct()

    def tombstone(self, digests: DataFrame, reason: str) -> None:
        """Destroys bytes and records why: the record first."""
        gone = checkpointed(digests.select("digest").distinct())
        gone.select("digest", F.lit(reason).alias("reason")).write.mode("append").parquet(f"{self.path}/{self._folder('tombstones')}")
        self._rewrite("blocks", self.blocks_held(), "memory_type")
        self._rewrite("blobs", self.blobs())

    def delete(self, digests: DataFrame) -> None:
        """Removes bytes and tombstones alike, as if they had never been held."""
        gone = checkpointed(digests.select("digest").distinct())
        self._rewrite("blocks", self.blocks_held().join(gone.select(F.col("digest").alias("block_id")), "block_id", "left_anti"), "memory_type")
        self._rewrite("blobs", self.blobs().join(gone, "digest", "left_anti"))
        self._rewrite("tombstones", self.tombstones().join(gone, "digest", "left_anti"))

    def get_block(self, memory_type: str, block_id: str) -> DataFrame:
        """One row with p and payload; refused if it is not a member of the module, not held, or not what its id says."""
        if self.composition().where((F.col("memory_type") == memory_type) & (F.col("block_id") == block_id)).isEmpty():
            raise MembershipError(f"{block_id} is not in the module {memory_type}")
        own = self.blocks_held().where((F.col("memory_type") == memory_type) & (F.col("block_id") == block_id))
        row = bl.verified(own).select("verified", bl.decode_error(F.col("canonical"), memory_type).alias("error")).first()
        if row is None or not row.verified or row.error:
            raise BlockIntegrityError(f"{block_id} is {'not held' if row is None else row.error or 'not what its id says'}")
        return bl.decoded(own)

    def corrupt_blobs(self) -> DataFrame:
        return self.blobs().where(digest(F.col("bytes")) != F.col("digest")).select("digest")

    # --- snapshots --------------------------------------------------------------------------------------------------

    def state(self) -> dict | None:
        return self.files.read_json("head.json")

    def snapshot(self, name: str | None = None) -> dict:
        state = self.state()
        name = name or (state and state["snapshot"])
        if name is None:
            return {"modules": {}, "parents": []}
        file = f"snapshots/{name.removeprefix('sha256:')}.json"
        if not self.files.exists(file):
            raise SnapshotError(f"snapshot {name} is not held")
        document = self.files.read_json(file)
        document["parents"] = document.get("parents") or ([document["parent"]] if "parent" in document else [])
        for kind, module in document["modules"].items():
            merkle.require_layout(module["layout"])
            module["table"] = self.files.read_json(self._members_file(kind, module["root"]))["table"]
        return document

    @staticmethod
    def _members_file(kind: str, root: str) -> str:
        """Names the folder with the ids that a root commits to; the root alone is in the snapshot."""
        return f"members/{kind}-{root}.json"

    @staticmethod
    def snapshot_bytes(modules: dict, created_at: str, parents: list[str], labels: dict | None = None) -> bytes:
        """One parent is a scalar, several are a list, none is absent."""
        if len(set(parents)) < len(parents):
            raise SnapshotError("a parent is named twice")
        document = {ENVELOPE_KEY: VERSION, "modules": modules, "created_at": created_at}
        document |= {"labels": labels} if labels else {}
        document |= {"parent": parents[0]} if len(parents) == 1 else {"parents": parents} if parents else {}
        return canonical_json(document)

    def _advance(self, modules: dict, parents: list[str], labels: dict | None = None) -> str:
        for kind, module in modules.items():
            if not self.files.exists(self._members_file(kind, module["root"])):
                self.files.write(self._members_file(kind, module["root"]), canonical_json({"table": module["table"]}))
        named = {kind: {k: v for k, v in module.items() if k != "table"} for kind, module in modules.items()}
        document = self.snapshot_bytes(named, self.clock(), parents, labels)
        name = "sha256:" + hashlib.sha256(document).hexdigest()
        self.files.write(f"snapshots/{name.removeprefix('sha256:')}.json", document)
        old = self.state() or {"retained": []}
        retained = [name, *(x for x in old["retained"] if x != name)][: self.policy.retained_roots]
        self.files.write("head.json", canonical_json({"snapshot": name, "retained": retained}))
        return name

    def history(self) -> list[str]:
        return (self.state() or {"retained": []})["retained"]

    def ancestry(self, name: str | None = None) -> list[str]:
        """First parents, newest first."""
        state = self.state()
        name = name or (state and state["snapshot"])
        out = []
        while name and self.files.exists(f"snapshots/{name.removeprefix('sha256:')}.json"):
            out.append(name)
            name = next(iter(self.snapshot(name)["parents"]), None)
        return out

    def reachable_history(self, name: str | None = None) -> list[str]:
        state = self.state()
        todo = [name or (state and state["snapshot"])]
        seen: dict[str, None] = {}
        while todo:
            name = todo.pop(0)
            if name and name not in seen and self.files.exists(f"snapshots/{name.removeprefix('sha256:')}.json"):
                seen[name] = None
                todo += self.snapshot(name)["parents"]
        return list(seen)

    def snapshots_between(self, base: str, name: str | None = None) -> list[str]:
        """The first-parent chain from behind base to name, oldest first."""
        chain = self.ancestry(name)
        if base not in chain:
            raise NoCommonAncestor(f"{base} is not in the first-parent chain")
        return chain[: chain.index(base)][::-1]

    def without_module(self, memory_type: str) -> str:
        """The next snapshot, in which the module is not installed."""
        return self._advance({k: m for k, m in self.snapshot()["modules"].items() if k != memory_type}, [self.state()["snapshot"]])

    def installed(self) -> list[str]:
        return [k for k in MEMORY_TYPES if k in self.snapshot()["modules"]]

    def block_count(self) -> int:
        return sum(m["block_count"] for m in self.snapshot()["modules"].values())

    def common_ancestor(self, theirs: str) -> str:
        """The first snapshot of theirs, by generations, that our history holds."""
        ours, frontier, seen = set(self.reachable_history()), [theirs], {theirs}
        while frontier:
            for name in frontier:
                if name in ours:
                    return name
            parents = [p for n in frontier if self.files.exists(f"snapshots/{n.removeprefix('sha256:')}.json") for p in self.snapshot(n)["parents"]]
            frontier = [p for p in dict.fromkeys(parents) if p not in seen]
            seen.update(frontier)
        raise NoCommonAncestor("the histories share no snapshot")

    # --- reading ----------------------------------------------------------------------------------------------------

    def composition(self, name: str | None = None) -> DataFrame:
        out = self.spark.createDataFrame([], IDS)
        for kind, module in self.snapshot(name)["modules"].items():
            own = self.spark.read.schema("block_id string").parquet(f"{self.path}/{module['table']}")
            out = out.unionByName(own.select(F.lit(kind).alias("memory_type"), "block_id"))
        return out

    def composition_at(self, name: str) -> DataFrame:
        """The composition of a snapshot, after its ids were folded anew to the roots that the snapshot commits to."""
        wanted = {k: m["root"] for k, m in self.snapshot(name)["modules"].items()}
        found = {r.memory_type: r.root for r in merkle.roots(self.composition(name)).collect()}
        if bad := [k for k, root in wanted.items() if found.get(k, merkle.EMPTY_ROOT) != root]:
            raise SnapshotError(f"the ids of {', '.join(bad)} do not fold to the snapshot's root")
        return self.composition(name)

    def blocks(self, name: str | None = None) -> DataFrame:
        return self.blocks_held().join(self.composition(name), KEY, "left_semi")

    def root_of(self, memory_type: str) -> str | None:
        module = self.snapshot()["modules"].get(memory_type)
        return module and module["root"]

    def records(self) -> DataFrame:
        return bl.records(self.blocks())

    def search(self, query: retrieval.Query, planner: Callable | None = None) -> DataFrame:
        """planner: (query, views) to candidates (block_id, score), instead of the scan."""
        records, views = self.records(), bl.views(bl.verified(self.blocks()))
        edges = bl.references(self.blocks().where("memory_type = 'semantic'")) if query.expand_depth else None
        found = planner(query, views) if planner else retrieval.candidates(views, query, edges, ledger.inaccessible(records))
        return retrieval.matches(found, views, query, ledger.locators(records), ledger.superseded_by(records))

    def verified_against(self, query: retrieval.Query) -> dict[str, str]:
        """The root of each module that the query searches: what its matches were read under."""
        kinds = query.memory_types or MEMORY_TYPES
        return {k: m["root"] for k, m in self.snapshot()["modules"].items() if k in kinds}

    def resolve(self, block_id: str) -> DataFrame:
        return retrieval.resolve(self.blocks(), block_id, MEMORY_TYPES)

    def prove(self, block_ids: DataFrame) -> DataFrame:
        """block_ids (memory_type, block_id) with leaf_index, tree_size, audit_path and root."""
        own = self.composition()
        return merkle.proofs(own).join(block_ids, KEY, "left_semi").join(merkle.roots(own).select("memory_type", "root"), "memory_type")

    def verify(self) -> DataFrame:
        """(memory_type, n_blocks, root_holds, n_corrupt): roots anew, and the digest of every block that is left."""
        stored = [(k, m["root"]) for k, m in self.snapshot()["modules"].items()]
        wanted = self.spark.createDataFrame(stored, "memory_type string, wanted string")
        bad = self.blocks().groupBy("memory_type").agg(F.count_if(digest(F.col("canonical")) != F.col("block_id")).alias("n_corrupt"))
        joined = wanted.join(merkle.roots(self.composition()), "memory_type", "left").join(bad, "memory_type", "left")
        holds = F.coalesce("root", F.lit(merkle.EMPTY_ROOT)) == F.col("wanted")
        return joined.select("memory_type", F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"), holds.alias("root_holds"), F.coalesce("n_corrupt", F.lit(0)).alias("n_corrupt"))

    def resolvability(self) -> DataFrame:
        own = self.composition()
        named = content_named(bl.content_of(self.blocks())).join(own, "block_id")
        names = own.select("memory_type", F.col("block_id").alias("digest")).unionByName(named.select("memory_type", "digest"))
        every = self.blocks_held().select(F.col("block_id").alias("digest")).unionByName(self.blobs().select("digest"))
        return retrieval.resolvability(names, every, self.tombstones())

    # --- writing ----------------------------------------------------------------------------------------------------

    def write(self, rows: DataFrame, without: DataFrame | None = None, parents: list[str] | None = None, exact: DataFrame | None = None) -> str:
        """rows: blocks to add; without: (memory_type, block_id) to leave out; exact: the composition itself instead.

        Blocks first, then memberships and roots, the pointer last.
        """
        if self.files.exists("reconcile.json"):
            raise LodestoneError("a reconciliation is open")
        rows = checkpointed(rows.select("memory_type", "block_id", "schema_version", "canonical").dropDuplicates(KEY))
        held = self._table("blocks", "block_id string, schema_version int, canonical string, memory_type string")
        rows.join(held, KEY, "left_anti").write.mode("append").partitionBy("memory_type").parquet(f"{self.path}/{self._folder('blocks')}")
        old = self.snapshot()
        ids = exact if exact is not None else composition.add(self.composition(), rows)
        touched = {r[0] for r in rows.select("memory_type").distinct().collect()}
        if without is not None:
            without = without.select(*KEY)
            ids = composition.drop(ids, without)
            touched |= {r[0] for r in without.select("memory_type").distinct().collect()}
        ids = checkpointed(ids.select(*KEY).distinct())
        if exact is not None:
            touched = set(MEMORY_TYPES)
        changed = ids.where(F.col("memory_type").isin(*touched)) if touched else ids.where(F.lit(False))
        roots = {r.memory_type: r for r in merkle.roots(changed).collect()}
        modules = {k: m for k, m in old["modules"].items()}
        for kind in MEMORY_TYPES:
            if kind in touched and (kind in roots or kind in modules):
                name = f"compositions/{kind}-{uuid.uuid4().hex}"
                ids.where(F.col("memory_type") == kind).select("block_id").write.parquet(f"{self.path}/{name}")
                found = roots.get(kind)
                modules[kind] = {
                    "root": found.root if found else merkle.EMPTY_ROOT, "block_count": found.n_blocks if found else 0,
                    "layout": merkle.LAYOUT, "table": name,
                }
        state = self.state()
        return self._advance(modules, parents if parents is not None else [state["snapshot"]] if state else [])

    def register(self, sources: DataFrame, actor: dict[str, str] = ACTOR, normalize: Callable | None = None) -> str | None:
        """sources (bytes, media_type): canonical blocks and their registration records; what is held is left alone.

        normalize: a Column function from bytes to the normalized view's text.
        """
        stored = self.put_bytes(sources)
        fields = {"blob": F.col("digest"), "media_type": F.col("media_type"), "size": F.col("size")}
        if normalize is not None:
            view = normalize(F.col("bytes"))
            self.put_bytes(stored.select(F.encode(view, "utf-8").alias("bytes")))
            fields["normalized_view"] = record(blob=digest(view), media_type=F.lit("text/plain"), size=F.octet_length(view).cast("long"))
        built = bl.build(stored, "canonical", record(**fields)).dropDuplicates(["block_id"])
        new = checkpointed(built.join(self.composition(), KEY, "left_anti").select("memory_type", "block_id", "schema_version", "canonical"))
        if new.isEmpty():
            return None
        entries = bl.provenance_record(new.drop("memory_type", "schema_version", "canonical"), "registration", self.clock(), actor, block=F.col("block_id"))
        return self.write(new.unionByName(entries))

    def replace(self, old: str, source: DataFrame, actor: dict[str, str] = ACTOR, reason: str | None = None) -> str:
        """source: one row (bytes, media_type); refused if it is byte-identical to what it replaces."""
        if self.composition().where((F.col("memory_type") == "canonical") & (F.col("block_id") == old)).isEmpty():
            raise MembershipError(f"{old} is not held")
        before = self.composition()
        self.register(source, actor)
        new = self.composition().join(before, KEY, "left_anti").where("memory_type = 'canonical'").first()
        if new is None:
            raise MembershipError("the source is held already")
        return self.supersede(old, new.block_id, actor, reason)

    def validate(self, candidates: DataFrame, allowed: tuple[str, ...] = gate.PROPOSABLE, review: bool = False) -> DataFrame:
        """candidates (candidate, memory_type, payload struct p of PAYLOAD's fields, cited): (candidate, status, codes, n_issues)."""
        rows, issues = self._judge(candidates, allowed, review)
        return gate.verdicts(rows, issues)

    def _judge(self, candidates: DataFrame, allowed, review: bool, check_duplicates: bool = True):
        p = F.col("p")
        rows = candidates.select(
            "candidate", "memory_type", "block_id", p["label"].alias("label"), p["subject"].alias("subject"), p["kind"].alias("kind"),
            p["statement"].alias("statement"), p["evidence"].alias("evidence"), "cited", p["relations"].alias("relations"),
            p["content"].alias("content"), bl.missing_fields(F.col("memory_type"), p).alias("required"),
        )
        held = bl.decoded(self.blocks()).select(
            "memory_type", "block_id", *(F.col(f"p.{c}").alias(c) for c in ("label", "subject", "kind", "statement"))
        )
        return rows, gate.issues(rows, held, self.blobs().select("digest", "size"), allowed, review, check_duplicates)

    def propose(self, rows: DataFrame) -> DataFrame:
        """rows (candidate, canonical, memory_type, cited): candidates with p and block_id."""
        return bl.decoded(rows.withColumn("block_id", digest(F.col("canonical"))))

    def commit(self, candidates: DataFrame, producer: dict[str, str], allowed: tuple[str, ...] = gate.PROPOSABLE, actor: dict[str, str] = ACTOR) -> str | None:
        """The validated candidates and a derivation of each; others are left out, and without any nothing is written."""
        candidates = checkpointed(candidates)
        ok = checkpointed(gate.committable(candidates, self.validate(candidates, allowed)))
        if ok.isEmpty():
            return None
        rows = ok.select("memory_type", "block_id", F.lit(1).alias("schema_version"), "canonical")
        made = record(**{k: F.lit(v) for k, v in producer.items()})
        derived = bl.provenance_record(
            ok.select("block_id", "cited"), "derivation", self.clock(), actor, block=F.col("block_id"), derived_from=F.col("cited"), producer=made
        )
        return self.write(rows.unionByName(derived))

    def ingest(self, sources: DataFrame, proposer: Callable[[DataFrame], DataFrame], producer: dict[str, str]) -> str | None:
        """Registers, asks the proposer (canonical blocks to candidates), validates, commits."""
        self.register(sources)
        return self.commit(self.propose(proposer(self.blocks().where("memory_type = 'canonical'"))), producer)

    # --- retention --------------------------------------------------------------------------------------------------

    def _ids(self, ids: list[str]) -> DataFrame:
        return self.spark.createDataFrame([(i,) for i in ids], "block_id string")

    def plan_drop(self, origins: DataFrame) -> DataFrame:
        """origins (block_id): (origin, block_id, memory_type, via)."""
        own = self.blocks()
        return graph.cascade(ledger.citations(bl.records(own)), bl.references(own), self.composition(), origins)

    def drop(self, origins: DataFrame, memory_type: str, reason: str, actor: dict[str, str] = ACTOR) -> DropResult:
        self.policy.authorize("drop", memory_type)
        origins = checkpointed(origins.select("block_id").distinct())
        members = self.composition().where(F.col("memory_type") == memory_type)
        if not origins.join(members, "block_id", "left_anti").isEmpty():
            raise MembershipError(f"not all are in the module {memory_type}")
        return self._drop(origins.select(F.lit(memory_type).alias("memory_type"), "block_id"), reason, actor)

    def _drop(self, origins: DataFrame, reason: str, actor: dict[str, str]) -> DropResult:
        """origins (memory_type, block_id) and all that depends on them, in one snapshot; none if the policy asks for a review."""
        if origins.isEmpty():
            return DropResult(False, None, 0)
        own = origins.select("block_id").distinct()
        dependents = checkpointed(graph.cascade_of_batch(self.plan_drop(own), own))
        n = dependents.count()
        if self.policy.requires_review(n):
            return DropResult(True, None, n)
        gone = checkpointed(dependents.unionByName(origins.select(*KEY)).distinct())
        for row in gone.select("memory_type").distinct().collect():
            self.policy.authorize("drop", row[0])
        first = own.agg(F.min("block_id")).first()[0]
        named = [r[0] for r in origins.select("memory_type").distinct().collect()]
        removal = gone.groupBy(F.col("memory_type").alias("m")).agg(F.array_sort(F.collect_list("block_id")).alias("ids"))  # one record names them
        entries = bl.provenance_record(
            removal, "removal", self.clock(), actor, blocks=F.col("ids"), mechanism=F.lit("drop"), memory_type=F.col("m"), reason=F.lit(reason),
            cascaded_from=F.when(~F.col("m").isin(*named), F.lit(first)),
        )
        return DropResult(False, self.write(entries, without=gone), n)

    def drop_by_producer(self, kind: str, producer_id: str, version: str | None, reason: str, actor: dict[str, str] = ACTOR) -> DropResult:
        """What a producer made, in all modules, and what depends on it, in one snapshot or none."""
        made = self.composition().join(ledger.made_by(self.records(), kind, producer_id, version), "block_id", "left_semi")
        return self._drop(checkpointed(made.select(*KEY).distinct()), reason, actor)

    def supersede(self, old: str, new: str, actor: dict[str, str] = ACTOR, reason: str | None = None) -> str:
        fields = {"block": F.lit(new), "supersedes": F.lit(old)} | ({"reason": F.lit(reason)} if reason else {})
        return self.write(bl.provenance_record(self._ids([old]), "supersession", self.clock(), actor, **fields))

    def demote(self, ids: list[str], reason: str | None = None, actor: dict[str, str] = ACTOR) -> str:
        fields = {"block": F.col("block_id")} | ({"reason": F.lit(reason)} if reason else {})
        return self.write(bl.provenance_record(self._ids(ids), "demotion", self.clock(), actor, **fields))

    def prune(self, dry_run: bool = True) -> DataFrame:
        """(digest) held but named by no retained snapshot; removed from the tables unless dry_run."""
        retained = None
        for name in self.history():
            own = self.composition(name)
            retained = own if retained is None else retained.unionByName(own)
        retained = retained if retained is not None else self.composition()
        every = self.blocks_held()
        held = every.select(F.col("block_id").alias("digest")).unionByName(self.blobs().select("digest"))
        keep = mark(retained, bl.content_of(every), held.where(F.lit(False)))
        gone = checkpointed(sweep(held, keep))
        if not dry_run:
            self._rewrite("blocks", self.blocks_held().join(gone.withColumnRenamed("digest", "block_id"), "block_id", "left_anti"), "memory_type")
            self._rewrite("blobs", self.blobs().join(gone, "digest", "left_anti"))
        return gone

    def redact(self, ids: list[str], reason: str, actor: dict[str, str] = ACTOR) -> DataFrame:
        """The record first, then the bytes: blocks and content that no other live block names.  Returns the digests."""
        self.policy.authorize("tombstone", "canonical")
        target = self._ids(ids)
        digests = checkpointed(redactable(target, self.composition(), bl.content_of(self.blocks())))
        one = target.agg(F.array_sort(F.collect_list("block_id")).alias("ids"))
        self.write(bl.provenance_record(
            one, "removal", self.clock(), actor, blocks=F.col("ids"), mechanism=F.lit("tombstone"), memory_type=F.lit("canonical"), reason=F.lit(reason)
        ))
        self.tombstone(digests, reason)
        return digests

    def _rewrite(self, name: str, rows: DataFrame, partition: str | None = None) -> None:
        """The new rows go to a folder of their own; then the pointer moves, and only then the old folder goes."""
        old = self._folder(name)
        if self.files.exists(old):
            new = f"{name}-{uuid.uuid4().hex}"
            writer = rows.write
            (writer.partitionBy(partition) if partition else writer).parquet(f"{self.path}/{new}")
            self.files.write("tables.json", canonical_json({**(self.files.read_json("tables.json") or {}), name: new}))
            self.files.delete(old)

    # --- distribution -----------------------------------------------------------------------------------------------

    def pack(self, memory_types: tuple[str, ...] | None = None) -> dict[str, bytes]:
        """A layer for each module, byte-identical for the same content.  A layer is one file, built on the driver."""
        kinds = memory_types or tuple(self.snapshot()["modules"])
        if {"semantic", "procedural"} & set(kinds) and "canonical" not in kinds:
            raise DistributionError("derived modules are published with their canonical evidence")
        documents = {r.memory_type: r.document for r in composition.document(self.composition(), merkle.LAYOUT).collect()}
        out = {}
        for kind in kinds:
            own = self.blocks().where(F.col("memory_type") == kind)
            named = content_named(bl.content_of(own)).select("digest").distinct()
            rows = own.select(F.col("block_id").alias("digest"), F.encode("canonical", "utf-8").alias("bytes")).unionByName(
                self.blobs().join(named, "digest", "left_semi").select("digest", "bytes")
            )
            blobs = [(r.digest.removeprefix("sha256:"), bytes(r.bytes)) for r in rows.toLocalIterator()]
            out[kind] = layers.pack(documents[kind].encode(), blobs)
        return out

    def unpack(self, packed: dict[str, bytes], parents: list[str] | None = None) -> str:
        """Layers of another store become this one's next version; every digest, and completeness, is checked."""
        import json

        rows, content = [], []
        for kind, layer in packed.items():
            document, blobs = layers.unpack(layer)
            ids = [i.removeprefix("sha256:") for i in json.loads(document)["block_ids"]]
            if missing := [i for i in ids if i not in blobs]:
                raise DistributionError(f"{len(missing)} blocks of {kind} are not in its layer")
            rows += [(kind, f"sha256:{i}", json.loads(blobs[i])["schema_version"], blobs[i].decode()) for i in ids]
            content += [(bytearray(b),) for i, b in blobs.items() if i not in set(ids)]
        if content:
            self.put_bytes(self.spark.createDataFrame(content, "bytes binary"))
        return self.write(self.spark.createDataFrame(rows, bl.SCHEMA), parents=parents)

    def plan_pull(self, remote: dict[str, str]) -> dict[str, str]:
        """remote: layer digests by module.  fetch or reuse, by what this store would pack itself."""
        own = {k: layers.digest(v) for k, v in self.pack().items()} if self.snapshot()["modules"] else {}
        return {k: "reuse" if own.get(k) == d else "fetch" for k, d in remote.items()}

    def require_fast_forward(self, published: str) -> None:
        if published not in self.reachable_history():
            raise DivergenceError("the published snapshot is not in this history; reconcile first")

    # --- reconciliation ---------------------------------------------------------------------------------------------

    def fetch(self, other: KnowledgeStore) -> str:
        """Blocks, content and snapshots of another store, without adopting them.  Returns its head."""
        if other.files.exists(other._folder("blobs")):
            self.put_bytes(other.blobs().select("bytes"))
        held = self._table("blocks", "block_id string, schema_version int, canonical string, memory_type string")
        other.blocks_held().join(held, KEY, "left_anti").write.mode("append").partitionBy("memory_type").parquet(f"{self.path}/{self._folder('blocks')}")
        for name in other.reachable_history():
            file = f"snapshots/{name.removeprefix('sha256:')}.json"
            if not self.files.exists(file):
                for kind, module in other.snapshot(name)["modules"].items():
                    if not self.files.exists(self._members_file(kind, module["root"])):
                        self.spark.read.parquet(f"{other.path}/{module['table']}").write.mode("overwrite").parquet(f"{self.path}/{module['table']}")
                        self.files.write(self._members_file(kind, module["root"]), canonical_json({"table": module["table"]}))
                self.files.write(file, other.files.read(file))
        return other.state()["snapshot"]

    def _installed(self, theirs: str) -> tuple[set[str], set[str]]:
        return set(self.snapshot()["modules"]), set(self.snapshot(theirs)["modules"])

    def plan_reconcile(self, theirs: str) -> ReconcilePlan:
        base = self.common_ancestor(theirs)
        ours = self.composition()
        merged = checkpointed(merging.merge(self.composition(base), ours, self.composition(theirs), installed=self._installed(theirs)))
        every = self.blocks_held().join(merging.members(merged), KEY, "left_semi")
        gone = merged.where("outcome = 'removed'").select("block_id")
        dangling = graph.cascade(ledger.citations(bl.records(every)), bl.references(every), merging.members(merged), gone)
        extra = checkpointed(graph.cascade_of_batch(dangling, gone))
        outcome = F.when(F.col("x").isNotNull(), "removed").otherwise(F.col("outcome"))
        merged = checkpointed(
            merged.join(extra.withColumn("x", F.lit(True)), KEY, "left").select(*KEY, outcome.alias("outcome"))
        )
        incoming = merging.incoming(merged, ours)
        derived = self.blocks_held().join(incoming, KEY, "left_semi").where("memory_type IN ('semantic', 'procedural', 'episodic')")
        candidates = self.propose(derived.select(F.col("block_id").alias("candidate"), "canonical", "memory_type"))
        candidates = candidates.withColumn("cited", F.coalesce("p.evidence", F.array().cast("array<string>")))
        rows, issues = self._judge(candidates, gate.PROPOSABLE, False, check_duplicates=False)
        arriving = incoming.select(F.col("block_id").alias("detail"))
        supplied = issues.where("code IN ('evidence-not-found', 'relation-target-not-found')").join(arriving, "detail", "left_semi")
        issues = issues.join(supplied, ["candidate", "code", "detail"], "left_anti")
        contested = ledger.contested(bl.records(every)).select(F.col("successor").alias("candidate"))
        fights = contested.join(rows.select("candidate"), "candidate", "left_semi").select(
            "candidate", F.lit("competing-supersession").alias("code"), F.lit("").alias("detail")
        )
        verdicts = checkpointed(gate.verdicts(rows, issues.unionByName(fights.distinct())))
        withdrawn = checkpointed(merging.withdrawn(merged, ours))
        clean = verdicts.where("status <> 'validated'").isEmpty() and withdrawn.isEmpty()
        noop = incoming.isEmpty() and withdrawn.isEmpty()
        return ReconcilePlan(base, merged, withdrawn, verdicts, clean, noop)

    def attribution(self, theirs: str, strategy: str = "merge") -> list[dict]:
        """For each snapshot of theirs since the common base who is named as its author after adopting it by the strategy.

        A merge keeps every snapshot, a rebase writes each again, a squash has one for all of them.
        """
        base = self.common_ancestor(theirs)
        keeps = {"merge": "kept", "rebase": "rewritten", "squash": "folded"}[strategy]
        return [{"snapshot": n, "created_at": self.snapshot(n)["created_at"], "fate": keeps} for n in self.snapshots_between(base, theirs)]

    def reconcile_status(self) -> dict | None:
        """The open reconciliation, or None."""
        return self.files.read_json("reconcile.json")

    def _open(self) -> dict:
        state = self.reconcile_status()
        if state is None:
            raise LodestoneError("no reconciliation is open")
        return state

    def reconcile_resolve(self, block_id: str, choice: str) -> dict:
        """choice: admit, reject, or prefer (admit it, and reject what it contradicts); kept with the open state."""
        state = self._open()
        if choice not in ("admit", "reject", "prefer") or block_id not in state["open"]:
            raise ResolutionRefused(f"{block_id} is not open, or {choice!r} is no resolution")
        if choice != "reject" and state["open"][block_id] == "rejected":
            raise ResolutionRefused(f"{block_id} failed the gate and cannot be admitted")
        state["resolutions"][block_id] = choice
        self.files.write("reconcile.json", canonical_json(state))
        return state

    def reconcile_accept_removals(self) -> dict:
        state = self._open() | {"accept_removals": True}
        self.files.write("reconcile.json", canonical_json(state))
        return state

    def reconcile_continue(self) -> str:
        """Takes the open reconciliation up with what was resolved; halts again while something is open."""
        state = self._open()
        if state["ours"] != self.state()["snapshot"]:
            raise SnapshotError("the head has moved since the reconciliation halted; abort it")
        return self.reconcile(state["theirs"], state["strategy"], state["resolutions"], state["accept_removals"])

    def reconcile_abort(self) -> None:
        self._open()
        self.files.delete("reconcile.json")

    def _contradicted_by(self, ids: list[str]) -> DataFrame:
        """Our claims with the label, subject and kind of theirs but another statement."""
        claim = lambda df: bl.decoded(df).select("memory_type", "block_id", *(F.col(f"p.{c}").alias(c) for c in ("label", "subject", "kind", "statement")))
        theirs = claim(self.blocks_held().join(self._ids(ids), "block_id", "left_semi")).withColumnRenamed("statement", "other")
        same = theirs.select("label", "subject", "kind", "other")
        ours = claim(self.blocks().where("memory_type = 'semantic'"))
        hit = ours.join(same, [ours[c].eqNullSafe(same[c]) for c in ("label", "subject", "kind")])
        return hit.where("statement <> other").select("memory_type", "block_id").distinct()

    def _replay(self, base: str, theirs: str, final: DataFrame) -> str:
        """Our snapshots since base, written again one after another on top of theirs; the last has the merged set."""
        name = theirs
        chain = self.snapshots_between(base)
        ours = self.composition_at(base)
        for k, step in enumerate(chain):
            now = self.composition(step)
            exact = final
            if k < len(chain) - 1:
                added, gone = now.join(ours, KEY, "left_anti"), ours.join(now, KEY, "left_anti")
                exact = checkpointed(self.composition(name).unionByName(added).distinct().join(gone, KEY, "left_anti"))
            name = self.write(self.spark.createDataFrame([], bl.SCHEMA), parents=[name], exact=exact)
            ours = now
        return name if chain else self.write(self.spark.createDataFrame([], bl.SCHEMA), parents=[theirs], exact=final)

    def reconcile(self, theirs: str, strategy: str = "merge", resolutions: dict[str, str] | None = None, accept_removals: bool = False) -> str:
        """Adopts theirs into ours, with the same set in the end: merge has both as parents, squash one snapshot on ours,
        rebase our own snapshots again, one by one, on theirs.

        resolutions: block_id to admit, reject or prefer, for what is not validated; a rejected verdict cannot be
        admitted; prefer also withdraws what it contradicts.  While a question or a removal is open this halts, and
        writes nothing but reconcile.json, the state that reconcile_continue takes up.
        """
        resolutions = resolutions or {}
        plan = self.plan_reconcile(theirs)
        open_ = {r.candidate: r.status for r in plan.verdicts.where("status <> 'validated'").collect()}
        for block, choice in resolutions.items():
            if choice != "reject" and open_.get(block) == "rejected":
                raise ResolutionRefused(f"{block} failed the gate and cannot be admitted")
        pending = [b for b in open_ if b not in resolutions]
        if pending or (not accept_removals and not plan.withdrawn.isEmpty()):
            state = {"theirs": theirs, "ours": self.state()["snapshot"], "strategy": strategy, "open": open_, "resolutions": resolutions}
            self.files.write("reconcile.json", canonical_json(state | {"accept_removals": accept_removals}))
            raise ReconciliationHalted(f"{len(pending)} blocks are open, {plan.withdrawn.count()} would be withdrawn")
        final = merging.members(plan.merged)
        if refused := [b for b, choice in resolutions.items() if choice == "reject"]:
            final = final.join(self._ids(refused), "block_id", "left_anti").select(*KEY)
        if preferred := [b for b, choice in resolutions.items() if choice == "prefer"]:
            final = final.join(self._contradicted_by(preferred), KEY, "left_anti")
        final = checkpointed(final.select(*KEY))
        ours = self.state()["snapshot"]
        if self.files.exists("reconcile.json"):
            self.files.delete("reconcile.json")
        if strategy == "rebase":
            return self._replay(plan.base, theirs, final)
        return self.write(self.spark.createDataFrame([], bl.SCHEMA), parents=[ours, theirs] if strategy == "merge" else [ours], exact=final)
