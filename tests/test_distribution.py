"""Image layouts, tags and wire schemas."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.exceptions import DistributionError
from lodestone.plans import wire
from lodestone.sources.image_layout import Layout, read_blobs


def test_push_pull_and_read(spark, tmp_path):
    root = f"file://{tmp_path}/registry"
    layout = Layout(spark, root, "team/brain")
    first = layout.push("v1", b"{}", {"canonical": b"layer a", "semantic": b"layer b"})
    assert layout.push("v1", b"{}", {"semantic": b"layer b", "canonical": b"layer a"}) == first
    assert Layout(spark, root, "team/brain").pull("v1", ("semantic",)) == {"semantic": b"layer b"}
    with pytest.raises(DistributionError):
        layout.push("v1", b"{}", {"canonical": b"layer a"})
    with pytest.raises(DistributionError):
        layout.resolve("v2")
    blobs = read_blobs(spark, f"{root}/team/brain")
    assert blobs.count() == 4 and blobs.where("not intact").count() == 0
    assert {r.digest for r in blobs.collect()} == layout.reachable()
    blob = tmp_path / "registry/team/brain/blobs/sha256" / layout.layers("v1")["canonical"][7:]
    blob.write_bytes(b"tampered")
    blob.with_name(f".{blob.name}.crc").unlink()  # the local file system's own checksum
    assert read_blobs(spark, f"{root}/team/brain").where("not intact").select(F.col("digest")).count() == 1
    with pytest.raises(DistributionError):
        layout.pull("v1")


@pytest.mark.parametrize("name", ["../up", "/abs", "Upper", "a//b", ""])
def test_names_cannot_escape(spark, tmp_path, name):
    with pytest.raises(DistributionError):
        Layout(spark, f"file://{tmp_path}", name)


def test_wire_schemas(spark):
    schemas = wire.wire_schemas()
    assert json.loads(json.dumps(schemas)) == schemas
    semantic = schemas["payload/semantic"]
    assert semantic["required"] == ["kind", "label", "statement"] and semantic["properties"]["label"]["minLength"] == 1
    assert not semantic["additionalProperties"] and "goal" not in semantic["properties"]
    assert len(schemas["candidates"]["properties"]["candidates"]["items"]["oneOf"]) == 3
