"""OCI image-layout directories: blobs read by Spark, manifests and tags on the driver."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.exceptions import DistributionError
from lodestone.functions.identity import digest
from lodestone.sources.files import Files, canonical_json

LAYOUT_VERSION = "1.0.0"
MANIFEST = "application/vnd.oci.image.manifest.v1+json"
CONFIG = "application/vnd.lodestone.snapshot.v1+json"
LAYER = "application/vnd.lodestone.module.{}.v1.tar+gzip"
_NAME = re.compile(r"[a-z0-9]+(?:[._-][a-z0-9]+)*(?:/[a-z0-9]+(?:[._-][a-z0-9]+)*)*")
_TAG = re.compile(r"[A-Za-z0-9_][A-Za-z0-9._-]{0,127}")


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """(digest, bytes, size, intact) of every blob; intact if the bytes have the digest of their name."""
    raw = spark.read.format("binaryFile").load(f"{path.rstrip('/')}/blobs/sha256/*")
    named = raw.select(F.concat(F.lit("sha256:"), F.element_at(F.split("path", "/"), -1)).alias("digest"), F.col("content").alias("bytes"))
    return named.select("digest", "bytes", F.octet_length("bytes").cast("long").alias("size"), (digest(F.col("bytes")) == F.col("digest")).alias("intact"))


class Layout:
    """One repository in a layout directory: blobs by digest, artifacts by tag."""

    def __init__(self, spark: SparkSession, root: str, name: str):
        if not _NAME.fullmatch(name):
            raise DistributionError(f"{name!r} is not a repository name")
        self.files = Files(spark, f"{root.rstrip('/')}/{name}")
        marker = self.files.read_json("oci-layout")
        if marker is None:
            self.files.write("oci-layout", canonical_json({"imageLayoutVersion": LAYOUT_VERSION}))
            self.files.write("index.json", canonical_json({"schemaVersion": 2, "manifests": []}))
        elif marker.get("imageLayoutVersion") != LAYOUT_VERSION:
            raise DistributionError("the layout has a version that is not supported")

    def put(self, data: bytes) -> str:
        name = hashlib.sha256(data).hexdigest()
        if not self.files.exists(f"blobs/sha256/{name}"):
            self.files.write(f"blobs/sha256/{name}", data)
        return f"sha256:{name}"

    def get(self, name: str) -> bytes:
        data = self.files.read(f"blobs/sha256/{name.removeprefix('sha256:')}")
        if f"sha256:{hashlib.sha256(data).hexdigest()}" != name:
            raise DistributionError(f"{name} does not hold the bytes it is named by")
        return data

    def tags(self) -> dict[str, str]:
        entries = self.files.read_json("index.json")["manifests"]
        return {e["annotations"]["org.opencontainers.image.ref.name"]: e["digest"] for e in entries}

    def push(self, tag: str, config: bytes, layers: dict[str, bytes], annotations: dict[str, str] | None = None) -> str:
        """Blobs, then the manifest, then the tag.  A tag never loses modules that it has published."""
        if not _TAG.fullmatch(tag):
            raise DistributionError(f"{tag!r} is not a tag")
        if tag in self.tags() and (gone := set(self.layers(tag)) - set(layers)):
            raise DistributionError(f"{tag} would no longer publish {', '.join(sorted(gone))}")
        described = [self._describe(layers[k], LAYER.format(k)) for k in sorted(layers)]
        manifest = {"schemaVersion": 2, "mediaType": MANIFEST, "config": self._describe(config, CONFIG), "layers": described}
        raw = canonical_json(manifest | ({"annotations": annotations} if annotations else {}))
        name = self.put(raw)
        entry = {"mediaType": MANIFEST, "digest": name, "size": len(raw), "annotations": {"org.opencontainers.image.ref.name": tag}}
        kept = [e for e in self.files.read_json("index.json")["manifests"] if e["annotations"]["org.opencontainers.image.ref.name"] != tag]
        self.files.write("index.json", canonical_json({"schemaVersion": 2, "manifests": [*kept, entry]}))
        return name

    def _describe(self, data: bytes, media_type: str) -> dict:
        return {"mediaType": media_type, "digest": self.put(data), "size": len(data)}

    def resolve(self, tag: str) -> dict:
        import json

        if tag not in self.tags():
            raise DistributionError(f"{tag} is not published")
        return json.loads(self.get(self.tags()[tag]))

    def layers(self, tag: str) -> dict[str, str]:
        """Layer digests by module."""
        shape = re.compile(re.escape(LAYER).replace(re.escape("{}"), "(.+)"))
        return {m[1]: x["digest"] for x in self.resolve(tag)["layers"] if (m := shape.fullmatch(x["mediaType"]))}

    def pull(self, tag: str, memory_types: tuple[str, ...] | None = None) -> dict[str, bytes]:
        return {k: self.get(d) for k, d in self.layers(tag).items() if memory_types is None or k in memory_types}

    def reachable(self) -> set[str]:
        """What tagged artifacts name: manifests, configs and layers."""
        out = set(self.tags().values())
        for tag in self.tags():
            manifest = self.resolve(tag)
            out |= {manifest["config"]["digest"], *(x["digest"] for x in manifest["layers"])}
        return out
