"""Neighbours, closures and build order over edge tables, by frontiers that stay distributed."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one part of a table that is joined or grouped.
ROWS = 1 << 19


def parts_of(spark: SparkSession, size: int, each: int) -> int:
    """Parts in which rows are dealt: of about ``each`` (rows or bytes), and no fewer than the session's."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each))


def dealt(t: DataFrame, n: int, *keys: str) -> DataFrame:
    """``t`` by its keys in parts of about ``ROWS``, if it (or what it meets) has ``n`` rows; where the
    session's parts do, Spark's own exchange is left to choose."""
    spark = t.sparkSession
    parts = parts_of(spark, n, ROWS)
    return t if parts <= int(spark.conf.get("spark.sql.shuffle.partitions")) else t.repartition(parts, *keys)


def _new_folder(spark: SparkSession, name: str) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="codeloom-")
        spark.sparkContext.setCheckpointDir(folder)
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write a step in the shared folder (spark.checkpoint.dir) and read it again."""
    spark = df.sparkSession
    path = _new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept_by(df: DataFrame, name: str, parts: int, key: str) -> DataFrame:
    """``kept`` in buckets of ``key``: what is dealt by it in so many parts stays so when it is read, and
    windows within a key need no exchange."""
    spark = df.sparkSession
    path = _new_folder(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.bucketBy(min(parts, 100000), key).option("path", path).format("parquet").saveAsTable(table)
    return spark.table(table)


def neighbors(edges: DataFrame, symbols: DataFrame, start: DataFrame, kinds: tuple[str, ...], inbound: bool = False) -> DataFrame:
    """Symbols one edge away from ``start`` (id)."""
    a, b = ("dst", "src") if inbound else ("src", "dst")
    ids = edges.where(F.col("kind").isin(*kinds)).join(start.select(F.col("id").alias(a)), a, "left_semi").select(F.col(b).alias("id")).distinct()
    return symbols.join(ids, "id", "left_semi")


def closure(links: DataFrame, start: DataFrame, include_start: bool = False) -> DataFrame:
    """(node, depth): everything that ``links`` (a, b) reaches from ``start`` (node), each once, at
    its smallest depth. A start that is reached again is not listed unless ``include_start``."""
    links = kept(links.where("a is not null and b is not null").select("a", "b").distinct(), "links")
    seen = kept(start.select("node").distinct().select("node", F.lit(0).alias("depth")), "seen")
    frontier = seen
    depth = 0
    while True:
        depth += 1
        step = frontier.join(links, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct().join(seen, "node", "left_anti")
        frontier = kept(step.select("node", F.lit(depth).alias("depth")), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
        if depth % 10 == 0:
            seen = kept(seen, "seen")
    return seen if include_start else seen.where("depth > 0")


def hierarchy(edges: DataFrame, symbols: DataFrame, start: DataFrame, kinds: tuple[str, ...], inbound: bool = False) -> DataFrame:
    """Closure over edges of some kinds; only through symbols that exist."""
    a, b = ("dst", "src") if inbound else ("src", "dst")
    links = edges.where(F.col("kind").isin(*kinds)).select(F.col(a).alias("a"), F.col(b).alias("b"))
    links = links.join(symbols.select(F.col("id").alias("b")), "b", "left_semi")
    return closure(links, start.select(F.col("id").alias("node"))).withColumnRenamed("node", "id")


def dependents(deps: DataFrame, start: DataFrame) -> DataFrame:
    """Files that must be looked at again when ``start`` (node) change, themselves included."""
    return closure(deps.select(F.col("to_file").alias("a"), F.col("from_file").alias("b")), start, include_start=True)


def dependencies(deps: DataFrame, start: DataFrame) -> DataFrame:
    """Files that ``start`` need, themselves not included."""
    return closure(deps.select(F.col("from_file").alias("a"), F.col("to_file").alias("b")), start)


def topological_levels(deps: DataFrame, files: DataFrame) -> DataFrame:
    """(file, level): files whose dependencies are all on lower levels, from 0; files in or behind
    a cycle have level -1. Within a level the order is by path."""
    files = kept(files.select("file").distinct(), "files")
    links = deps.select("from_file", "to_file").where("from_file <> to_file").distinct()
    links = links.join(files.withColumnRenamed("file", "from_file"), "from_file", "left_semi").join(files.withColumnRenamed("file", "to_file"), "to_file", "left_semi")
    links, left, done, level = kept(links, "links"), files, None, 0
    while True:
        free = kept(left.join(links.select(F.col("from_file").alias("file")), "file", "left_anti").select("file", F.lit(level).alias("level")), "level")
        if free.isEmpty():
            break
        done = free if done is None else done.union(free)
        left = kept(left.join(free, "file", "left_anti"), "left")
        links = kept(links.join(free.select(F.col("file").alias("to_file")), "to_file", "left_anti"), "links")
        level += 1
    rest = left.select("file", F.lit(-1).alias("level"))
    return rest if done is None else done.union(rest)


def invalidation_order(deps: DataFrame, start: DataFrame) -> DataFrame:
    """(file, level) of the files that ``dependents`` gives, by level among themselves: every file
    after those of them that it needs."""
    files = kept(dependents(deps, start).select(F.col("node").alias("file")), "affected")
    return topological_levels(deps, files)


def adjacency(deps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file, files) forward and backward, stored, for many lookups; made again when files change."""
    side = lambda a, b: kept(deps.select(F.col(a).alias("file"), F.col(b).alias("to")).distinct().groupBy("file").agg(F.array_sort(F.collect_list("to")).alias("files")), "adjacency")
    return side("from_file", "to_file"), side("to_file", "from_file")
