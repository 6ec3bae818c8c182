"""A change feed that keeps an index table fresh, by buckets of files.

The table under ``base`` is cut into buckets by a hash of the file; a batch rewrites only the
buckets of its files, each into a new folder. The state is a manifest (last batch, folder of each
bucket) that is written under a temporary name and renamed to the next version: readers see one
complete version, and a batch that is replayed after its commit changes nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.maintenance import latest_changes

#: Buckets of a new table.
BUCKETS = 64


def _bucket(file: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(file), F.lit(buckets)).cast("int")


def _files(spark: SparkSession, base: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def _versions(spark: SparkSession, base: str) -> list[int]:
    fs, path = _files(spark, base)
    found = fs.globStatus(path(f"{base}/manifest-*.json"))
    return sorted(int(x.getPath().getName()[9:-5]) for x in found or [])


def manifest(spark: SparkSession, base: str) -> dict | None:
    versions = _versions(spark, base)
    if not versions:
        return None
    return json.loads(spark.read.text(f"{base}/manifest-{versions[-1]:012d}.json", wholetext=True).first()[0])


def _commit(spark: SparkSession, base: str, told: dict) -> None:
    versions = _versions(spark, base)
    fs, path = _files(spark, base)
    new = path(f"{base}/.manifest-{uuid.uuid4().hex}")
    out = fs.create(new)
    out.write(bytearray(json.dumps(told).encode()))
    out.close()
    if not fs.rename(new, path(f"{base}/manifest-{(versions[-1] if versions else 0) + 1:012d}.json")):
        raise RuntimeError("another writer has committed this version")


def _write(rows: DataFrame, base: str, file: str, buckets: int) -> dict[str, str]:
    """Rows into one new folder a bucket; returns the buckets that have rows."""
    target = f"{base}/data-{uuid.uuid4().hex}"
    rows = rows.withColumn("_bucket", _bucket(file, buckets))
    rows.repartition("_bucket").write.partitionBy("_bucket").parquet(target)
    fs, path = _files(rows.sparkSession, base)
    found = [x.getPath().getName() for x in fs.listStatus(path(target))]
    return {x.partition("=")[2]: f"{target}/{x}" for x in found if x.startswith("_bucket=")}


def create(table: DataFrame, base: str, file: str = "file", buckets: int = BUCKETS) -> None:
    """Make the table under ``base`` from rows."""
    parts = _write(table, base, file, buckets)
    _commit(table.sparkSession, base, {"batch": -1, "file": file, "buckets": buckets, "schema": table.schema.json(), "parts": parts})


def table(spark: SparkSession, base: str, only: list[str] | None = None) -> DataFrame:
    """The table as of its last version; of some buckets only, if given."""
    from pyspark.sql.types import StructType

    told = manifest(spark, base)
    schema = StructType.fromJson(json.loads(told["schema"]))
    paths = [p for b, p in told["parts"].items() if only is None or b in only]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def apply_changes(spark: SparkSession, base: str, changes: DataFrame, extract, batch: int) -> bool:
    """One batch of (path, op, seq): deleted and changed files lose their rows, changed ones get
    those of ``extract(paths)``. False if the batch was there already."""
    told = manifest(spark, base)
    if batch <= told["batch"]:
        return False
    file, buckets = told["file"], told["buckets"]
    last = latest_changes(changes)
    touched = [str(r[0]) for r in last.select(_bucket("path", buckets).alias("b")).distinct().collect()]
    if touched:
        keep = table(spark, base, touched).join(last.select(F.col("path").alias(file)), file, "left_anti")
        new = extract(last.where("op <> 'delete'").select("path"))
        parts = {b: p for b, p in told["parts"].items() if b not in touched}
        told["parts"] = parts | _write(keep.unionByName(new), base, file, buckets)
    _commit(spark, base, told | {"batch": batch})
    return True


def watch(spark: SparkSession, changes_dir: str, base: str, extract, checkpoint: str, once: bool = False):
    """A stream over a folder of change records (JSON lines) that keeps the table under ``base`` fresh."""
    feed = spark.readStream.schema("path string, op string, seq long").json(changes_dir)
    writer = feed.writeStream.foreachBatch(lambda df, batch: apply_changes(spark, base, df, extract, batch) and None).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()
