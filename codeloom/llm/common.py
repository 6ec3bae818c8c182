"""What the corpus operators share: the shared folder, stored tables, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Records and bytes of one Arrow batch, whichever comes first; a longer text is a batch of its own.
BATCH_RECORDS, BATCH_BYTES = 512, 16 << 20

#: ASCII white space as the contracts define it; ``bytes.split()`` cuts at exactly these.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a local session without one, as in tests, gets a temporary folder; elsewhere it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="codeloom-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    This cuts the lineage: later work restarts from the files if executors are lost.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables made by ``stored`` that nothing reads any more."""
    for table in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(table._stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def filesystem(uri: str):
    """The pyarrow file system and path of a URI, for use on executors and driver."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def read_bytes(uri: str) -> bytes:
    files, path = filesystem(uri)
    with files.open_input_file(path) as f:
        return f.read()


def write_bytes(uri: str, data: bytes) -> None:
    files, path = filesystem(uri)
    files.create_dir(path.rpartition("/")[0], recursive=True)
    with files.open_output_stream(path) as f:
        f.write(data)


def bound_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by records and bytes, unless smaller bounds are set.

    Spark reads these settings when a plan runs, so they cannot be given with one call.
    """
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for name, most in (("maxRecordsPerBatch", BATCH_RECORDS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        if not 0 < size(spark.conf.get(key)) <= most:
            spark.conf.set(key, str(most))


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with batches small enough for very long texts."""
    bound_batches(df.sparkSession)
    return df.mapInArrow(f, schema)


def ordered_parts(df: DataFrame, keys: list, name: str) -> DataFrame:
    """``df`` in the order of ``keys`` with ``part`` and ``g``, its number from 0 over all rows; stored.

    A range exchange deals the rows evenly however many have one key; the numbers of a part begin
    after the rows of those before it (one row a part is gathered for that). Rows with equal keys
    stand in any order.
    """
    n = partitions(df.sparkSession)
    t = stored(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("g", F.monotonically_increasing_id()), name)
    part, row = F.shiftright("g", 33).cast("int"), F.col("g").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = t.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    sizes = sizes.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    out = t.withColumn("part", part).withColumn("g", row).join(F.broadcast(sizes), "part").withColumn("g", F.col("g") + F.col("base")).drop("base")
    out._stored_at = t._stored_at
    return out


def carried(t: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds the largest ``value`` at or before each row in the order of (part, g), over all parts."""
    t = t.withColumn(name, F.max(value).over(W.partitionBy("part").orderBy("g").rowsBetween(W.unboundedPreceding, W.currentRow)))
    last = t.groupBy(F.col("part").alias("_part")).agg(F.max(name).alias("_last"))
    last = last.select("_part", F.max("_last").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)).alias("_last"))
    t = t.join(F.broadcast(last), F.col("part") == F.col("_part"))
    return t.withColumn(name, F.greatest(name, "_last")).drop("_part", "_last")


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have, made from ``names``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def byte_sizes(texts: pa.Array) -> list[int]:
    return pc.binary_length(texts).fill_null(0).to_pylist()


def pieces(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Neighbouring ranges whose sizes sum to ``most`` or little more."""
    start = total = 0
    for i, n in enumerate(sizes):
        total += n
        if total >= most:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def rows_out(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[x.name], x.type) for x in schema], schema=schema)
