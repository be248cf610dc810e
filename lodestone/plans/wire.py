"""JSON Schema (draft 2020-12) of what is exchanged, from Spark types."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegerType, LongType, MapType, StringType, StructType

from lodestone.plans.blocks import KINDS, PAYLOAD, REQUIRED

DRAFT = "https://json-schema.org/draft/2020-12/schema"
#: The fields of each memory type's payload beside the required ones.
OPTIONAL = {
    "canonical": ("normalized_view",),
    "semantic": ("subject", "evidence", "relations", "aliases", "content"),
    "procedural": ("subject", "evidence", "preconditions", "success_criteria", "content"),
    "episodic": ("ended_at", "context", "participants", "outcome", "evidence", "tags", "content"),
    "provenance": (),
}


def json_schema(kind: DataType) -> dict:
    if isinstance(kind, StructType):
        return {"type": "object", "properties": {f.name: json_schema(f.dataType) for f in kind.fields}, "additionalProperties": False}
    if isinstance(kind, ArrayType):
        return {"type": "array", "items": json_schema(kind.elementType)}
    if isinstance(kind, MapType):
        return {"type": "object", "additionalProperties": json_schema(kind.valueType)}
    for spark, name in ((StringType, "string"), (BooleanType, "boolean"), ((IntegerType, LongType), "integer")):
        if isinstance(kind, spark):
            return {"type": name}
    raise ValueError(f"{kind} has no canonical form")


def payload_schema(memory_type: str) -> dict:
    """Needs a running session, whose parser reads the type."""
    fields = StructType.fromDDL(f"p {PAYLOAD}")["p"].dataType
    names = (*REQUIRED[memory_type], *OPTIONAL[memory_type])
    properties = {n: json_schema(fields[n].dataType) for n in names}
    for name in REQUIRED[memory_type]:
        if properties[name].get("type") == "string":
            properties[name]["minLength"] = 1
    if memory_type == "semantic":
        properties["kind"]["enum"] = list(KINDS)
    if memory_type == "procedural":
        properties["steps"]["minItems"] = 1
    return {"type": "object", "properties": properties, "required": list(REQUIRED[memory_type]), "additionalProperties": False}


def candidates_schema(allowed: tuple[str, ...] = ("episodic", "semantic", "procedural")) -> dict:
    """What a proposer returns: a list of a memory type, its payload and what it cites."""
    variants = [
        {
            "type": "object", "required": ["memory_type", "payload"], "additionalProperties": False,
            "properties": {
                "memory_type": {"const": k}, "payload": payload_schema(k), "cited": {"type": "array", "items": {"type": "string"}}
            },
        }
        for k in allowed
    ]
    return {"$schema": DRAFT, "type": "object", "properties": {"candidates": {"type": "array", "items": {"oneOf": variants}}}, "required": ["candidates"]}


def wire_schemas() -> dict[str, dict]:
    return {**{f"payload/{k}": {"$schema": DRAFT} | payload_schema(k) for k in REQUIRED}, "candidates": candidates_schema()}
