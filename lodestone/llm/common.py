"""Helpers that the operators of this subpackage share: text rules, scratch tables, Arrow rows."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: The white space of every contract: space and \t \n \v \f \r.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_CLASS = "[\\x20\\x09-\\x0D]+"
#: Bytes to bytes: A-Z to lower case, every ASCII character that is neither digit nor letter to a space.
#: All of them are single bytes in UTF-8, so offsets stay as they were.
ALNUM_TABLE = bytes(
    (b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20)
    for b in range(256)
)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a folder of our own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        jdir = context._jsc.sc().getCheckpointDir()
        if jdir.isDefined():
            found = jdir.get()
        elif context.master.startswith("local"):
            found = "file://" + tempfile.mkdtemp(prefix="lodestone-")
            context.setCheckpointDir(found)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return found


def table(df: DataFrame, label: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Writes df once as Parquet in the shared folder and reads it back.

    This cuts lineage: a lost executor costs a re-read, never a recomputation of what stands above.  Shuffle files of the
    write are of no use after it and are removed.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(scratch: DataFrame, part: str | None = None) -> None:
    """Removes a table made by table(), or the folder of one of its partitions, that nothing reads any more."""
    spark = scratch.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch._scratch_path + (f"/{part}" if part else ""))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def strip_blanks(col: Column) -> Column:
    return F.btrim(col, F.lit(BLANKS))


def blank_words(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text as an array; null has none."""
    bare = strip_blanks(F.coalesce(text, F.lit("")))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_CLASS, -1))


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(text).alias("__t1"), F.xxhash64(F.lit("second half"), text).alias("__t2")]


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """A string column's values as UTF-8 bytes, without decoding them."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def arrow_schema(ddl: str) -> pa.Schema:
    """On the driver only: executors have no parser."""
    return to_arrow_schema(StructType.fromDDL(ddl))


def ship(spark: SparkSession) -> None:
    """Sends this package's sources to the executors, once a context: their Python need not find it by itself."""
    context, root = spark.sparkContext, Path(__file__).resolve().parent.parent
    if getattr(context, "_lodestone_shipped", False) or not root.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="lodestone-")) / "lodestone_sources.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._lodestone_shipped = True


def bounded_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches than Spark's defaults, which hold tens of MB on both sides of every Python worker.

    A session that has set its own limits keeps them.
    """
    ship(spark)
    for key, default, ours in (("maxRecordsPerBatch", "10000", "1000"), ("maxBytesPerBatch", "67108864b", "16777216b")):
        name = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(name) == default:
            spark.conf.set(name, ours)


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """fn: one batch to a list of columns (or None) in the schema's order."""
    bounded_batches(df.sparkSession)
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = fn(batch)
                if columns is not None and len(columns[0]):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow
                    )

    return df.mapInArrow(run, schema)
