"""Blocks as rows: payload schemas, decoding of canonical envelopes, views for retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from lodestone.functions.identity import block_id, digest, envelope, jcs, oldest_schema, record
from lodestone.functions.identity import decode_error as envelope_error
from lodestone.functions.text import folded

_CONTENT = "struct<blob:string,media_type:string,size:bigint>"
_RECORD = (
    "struct<record_type:string,block:string,blocks:array<string>,derived_from:array<string>,supersedes:string,locator:string,"
    "producer:struct<id:string,kind:string,version:string>,reason:string,at:string>"
)
#: All payload fields of all memory types; absent ones are null.
PAYLOAD = (
    f"struct<blob:string,media_type:string,size:bigint,normalized_view:{_CONTENT},content:{_CONTENT},kind:string,label:string,"
    "statement:string,subject:string,evidence:array<string>,relations:array<struct<predicate:string,target:string>>,aliases:array<string>,"
    "goal:string,steps:array<struct<action:string,condition:string,alternatives:array<string>,uses:array<string>>>,"
    "preconditions:array<string>,success_criteria:array<string>,summary:string,occurred_at:string,ended_at:string,context:string,"
    f"participants:array<string>,outcome:string,tags:array<string>,record:{_RECORD}>"
)
#: What a payload of a memory type must have.
REQUIRED = {
    "canonical": ("blob", "media_type", "size"),
    "semantic": ("kind", "label", "statement"),
    "procedural": ("label", "goal", "steps"),
    "episodic": ("summary", "occurred_at"),
    "provenance": ("record",),
}
KINDS = ("concept", "fact", "formula", "relation", "constraint")
SCHEMA = "memory_type string, block_id string, schema_version int, canonical string"


def build(df: DataFrame, memory_type: str, payload: Column, content: Column | None = None) -> DataFrame:
    """df's rows as blocks, under the oldest schema that holds them; df's columns stay."""
    version = oldest_schema(content) if content is not None else F.lit(1)
    canonical = envelope(memory_type, payload, version)
    own = df.withColumns({"memory_type": F.lit(memory_type), "schema_version": version.cast("int"), "canonical": canonical})
    return own.withColumn("block_id", block_id(F.col("canonical")))


def decoded(blocks: DataFrame) -> DataFrame:
    """blocks with p, the payload as a struct, and payload, its JSON."""
    parsed = F.from_json("canonical", f"struct<payload:{PAYLOAD}>")["payload"]
    raw = F.get_json_object("canonical", "$.payload")
    return blocks.withColumns({"p": parsed, "payload": raw})


def verified(blocks: DataFrame) -> DataFrame:
    """blocks with verified: whether their bytes hash to their id."""
    return blocks.withColumn("verified", digest(F.col("canonical")) == F.col("block_id"))


def decode_error(canonical: Column, expected_type: str) -> Column:
    """Null for the canonical bytes of a block of the type, else what is wrong with them.

    The payload is parsed into typed fields and written anew, so order, spacing, nulls, unknown fields and numbers that
    have no canonical form all show as a difference.
    """
    payload = F.get_json_object(canonical, "$.payload")
    typed = F.from_json(payload, _canonical_schema(PAYLOAD))
    return F.coalesce(envelope_error(canonical, expected_type), F.when(~jcs(typed).eqNullSafe(_raw_payload(canonical)), "not-canonical"))


def _raw_payload(canonical: Column) -> Column:
    """The payload's own bytes: what stands between the fixed parts of the envelope."""
    return F.regexp_extract(canonical, r'(?s)"payload":(.*),"schema_version":\d+,"serialization":"[^"]*"\}$', 1)


def _canonical_schema(kind: str) -> StructType:
    """The fields of every struct in the order of their names."""

    def ordered(x):
        if isinstance(x, StructType):
            return StructType([StructField(f.name, ordered(f.dataType)) for f in sorted(x.fields, key=lambda f: f.name)])
        return ArrayType(ordered(x.elementType)) if isinstance(x, ArrayType) else x

    return ordered(StructType.fromDDL(f"x {kind}")["x"].dataType)


def schema_versions(blocks: DataFrame) -> DataFrame:
    """(memory_type, versions, n_blocks); the versions in order."""
    return blocks.groupBy("memory_type").agg(
        F.array_sort(F.collect_set("schema_version")).alias("versions"), F.count(F.lit(1)).alias("n_blocks")
    )


def missing_fields(memory_type: Column, payload: Column) -> Column:
    """The first required field that is absent or empty, or null."""
    out = F.lit(None).cast("string")
    for kind, fields in REQUIRED.items():
        found = F.lit(None).cast("string")
        for name in reversed(fields):
            value = payload[name]
            empty = value.isNull() | ((value == "") if name not in ("size", "steps", "record") else (F.size(value) == 0) if name == "steps" else F.lit(False))
            found = F.when(empty, F.lit(name)).otherwise(found)
        if kind == "semantic":
            found = F.when(found.isNull() & ~payload["kind"].isin(*KINDS), "kind").otherwise(found)
        if kind == "episodic":
            found = F.when(found.isNull() & (payload["ended_at"] < payload["occurred_at"]), "ended_at").otherwise(found)
        out = F.when(memory_type == kind, found).otherwise(out)
    return out


def haystack(payload: Column) -> Column:
    """Of each type only its own fields are set, so one list in their order does for all."""
    p = payload
    each = [
        p["label"], p["statement"], p["goal"], p["subject"], p["aliases"], F.transform(p["steps"], lambda s: s["action"]),
        F.transform(p["steps"], lambda s: s["condition"]), p["preconditions"], p["success_criteria"], p["summary"], p["context"], p["outcome"],
        p["participants"], p["tags"], p["media_type"],
    ]
    return folded(F.concat_ws(" ", *each))


def views(blocks: DataFrame) -> DataFrame:
    p = F.col("p")
    return decoded(blocks).select(
        "block_id", "memory_type", p["subject"].alias("subject"), p["tags"].alias("tags"), p["evidence"].alias("evidence"),
        p["occurred_at"].alias("occurred_at"), haystack(p).alias("haystack"), "payload",
        *(["verified"] if "verified" in blocks.columns else []),
    )


def records(blocks: DataFrame) -> DataFrame:
    """Provenance blocks as the ledger's records."""
    own = decoded(blocks.where("memory_type = 'provenance'"))
    fields = ("record_type", "block", "blocks", "derived_from", "supersedes", "producer", "locator")
    return own.select(F.col("block_id").alias("entry_id"), *(F.col(f"p.record.{f}").alias(f) for f in fields))


def references(blocks: DataFrame) -> DataFrame:
    """Structural edges (src, dst): relations' targets and what steps use."""
    own = decoded(blocks.where("memory_type IN ('semantic', 'procedural')"))
    targets = F.transform("p.relations", lambda r: r["target"])
    uses = F.flatten(F.transform("p.steps", lambda s: F.coalesce(s["uses"], F.array().cast("array<string>"))))
    none = F.array().cast("array<string>")
    return own.select(F.col("block_id").alias("src"), F.explode(F.concat(F.coalesce(targets, none), F.coalesce(uses, none))).alias("dst")).distinct()


def content_of(blocks: DataFrame) -> DataFrame:
    """(block_id, content): the digests that a block names."""
    p = F.col("p")
    return decoded(blocks).select("block_id", F.array_compact(F.array(p["blob"], p["normalized_view"]["blob"], p["content"]["blob"])).alias("content"))


def provenance_record(df: DataFrame, record_type: str, at: str, actor: dict[str, str], **fields: Column) -> DataFrame:
    """Blocks of the module provenance, one for each row of df."""
    who = record(**{k: F.lit(v) for k, v in actor.items()})
    own = record(record_type=F.lit(record_type), at=F.lit(at), actor=who, **fields)
    return build(df, "provenance", record(record=own)).select("memory_type", "block_id", "schema_version", "canonical")
