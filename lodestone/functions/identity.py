"""Identity as Column expressions: canonical JSON, digests, envelopes, timestamps, media types.

Canonical JSON is to_json over a struct whose fields are in order of their names: absent optionals (nulls) are
dropped, strings are escaped as RFC 8785 asks, except that control characters get upper-case hex digits, which jcs()
puts right.  Numbers are longs within +-(2^53 - 1); floats are refused, decimals and timestamps are strings.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StringType, StructType

#: The envelope's version key.  It is inside the hash, so a store of other origin is read with its own key.
ENVELOPE_KEY = "lodestone"
VERSION = 1
SERIALIZATION = "jcs/1"
MEMORY_TYPES = ("canonical", "episodic", "semantic", "procedural", "provenance")
EMPTY_ROOT = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
SAFE_INTEGER = 2**53 - 1
DIGEST = "^sha256:[0-9a-f]{64}$"
_TOKEN = "[a-z0-9!#$&^_.+-]{1,127}"


def record(**fields: Column) -> Column:
    """A struct in canonical order."""
    return F.struct(*(fields[k].alias(k) for k in sorted(fields)))


def jcs(value: Column) -> Column:
    """Canonical JSON of a struct, array or map built from records."""
    text = F.to_json(value)
    fixed = text
    for code in [*range(0x0A, 0x10), *range(0x1A, 0x20)]:
        upper = f"{code:04X}"
        fixed = F.regexp_replace(fixed, rf"(?<!\\)((?:\\\\)*)\\u{upper}", rf"$1\\u{upper.lower()}")
    return F.when(text.rlike(r"\\u00[01][A-F]"), fixed).otherwise(text)


def digest(value: Column) -> Column:
    """sha256:<hex> of a string's UTF-8 bytes or of binary."""
    return F.concat(F.lit("sha256:"), F.sha2(value, 256))


def is_digest(value: Column) -> Column:
    return F.coalesce(value.rlike(DIGEST), F.lit(False))


def hex_of(value: Column) -> Column:
    return F.substring(value, 8, 64)


def raw_of(value: Column) -> Column:
    return F.unhex(hex_of(value))


def short(value: Column) -> Column:
    return F.substring(value, 8, 12)


def envelope(memory_type: str | Column, payload: Column, schema_version: int | Column, key: str = ENVELOPE_KEY) -> Column:
    """The canonical bytes, as text, whose digest is the block's id."""
    column = lambda x: x if isinstance(x, Column) else F.lit(x)
    fields = {
        key: F.lit(VERSION), "memory_type": column(memory_type), "payload": payload,
        "schema_version": column(schema_version), "serialization": F.lit(SERIALIZATION),
    }
    return jcs(record(**fields))


def block_id(canonical: Column) -> Column:
    return digest(canonical)


def oldest_schema(content: Column) -> Column:
    """The oldest schema that holds the payload: 2 if it names content, else 1."""
    return F.when(content.isNotNull(), 2).otherwise(1)


def utc_timestamp(at: Column) -> Column:
    """RFC 3339 in UTC, cut to seconds; the session's time zone must be UTC."""
    return F.date_format(F.date_trunc("second", at), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_timestamp(text: Column) -> Column:
    """Null unless the text is exactly what utc_timestamp writes."""
    shape = text.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$")
    return F.when(shape, F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")))


def is_media_type(text: Column) -> Column:
    return F.coalesce(text.rlike(f"^{_TOKEN}/{_TOKEN}$"), F.lit(False))


def is_interval(occurred_at: Column, ended_at: Column) -> Column:
    return ended_at.isNull() | (ended_at >= occurred_at)


def is_safe_integer(value: Column) -> Column:
    return value.between(-SAFE_INTEGER, SAFE_INTEGER)


def is_append_only(memory_type: Column) -> Column:
    return memory_type == "episodic"


def is_droppable(memory_type: Column) -> Column:
    return memory_type != "episodic"


def is_derived(memory_type: Column) -> Column:
    return memory_type.isin("semantic", "procedural")


def is_redaction(mechanism: Column) -> Column:
    return mechanism.isin("tombstone", "crypto_shred", "lineage_rewrite")


def refuse_non_deterministic(kind: DataType, path: str = "payload") -> None:
    """Raises for types that have no canonical form: floats, and maps whose keys are not strings."""
    if isinstance(kind, (FloatType, DoubleType)):
        raise ValueError(f"{path} is a float, which has no canonical form")
    if isinstance(kind, MapType):
        if not isinstance(kind.keyType, StringType):
            raise ValueError(f"{path} has keys that are not strings")
        refuse_non_deterministic(kind.valueType, f"{path}.*")
    if isinstance(kind, ArrayType):
        refuse_non_deterministic(kind.elementType, f"{path}[]")
    if isinstance(kind, StructType):
        for field in kind.fields:
            refuse_non_deterministic(field.dataType, f"{path}.{field.name}")


def decode_error(canonical: Column, expected_type: str, known_versions: tuple[int, ...] = (1, 2), key: str = ENVELOPE_KEY) -> Column:
    """Null for bytes that are a canonical envelope of the type, else what is wrong with them."""
    top = F.from_json(canonical, "map<string,string>")
    keys = F.array_sort(F.map_keys(top))
    wanted = F.array(*map(F.lit, sorted([key, "memory_type", "payload", "schema_version", "serialization"])))
    rebuilt = F.concat_ws(
        "", F.lit(f'{{"{key}":'), top[key], F.lit(',"memory_type":"'), top["memory_type"], F.lit('","payload":'), top["payload"],
        F.lit(',"schema_version":'), top["schema_version"], F.lit(',"serialization":"'), top["serialization"], F.lit('"}'),
    ) if key < "memory_type" else canonical
    return (
        F.when(top.isNull() | (F.size(keys) == 0), "not-json")
        .when(keys != wanted, "keys")
        .when(top[key] != str(VERSION), "protocol-version")
        .when(top["serialization"] != SERIALIZATION, "serialization")
        .when(top["memory_type"] != expected_type, "memory-type")
        .when(~top["schema_version"].isin(*map(str, known_versions)), "schema-version")
        .when(rebuilt != canonical, "not-canonical")
    )


def parse_digest(text: str) -> str:
    """Driver-side: the digest, or ValueError."""
    if not re.fullmatch(DIGEST.strip("^$"), text):
        raise ValueError(f"not a digest: {text!r}")
    return text
