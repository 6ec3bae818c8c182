"""Reading source trees, transcripts' results and change sets."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_supported
from ..schema import SKIPPED_FOLDERS


def scan_workspace(spark: SparkSession, root: str) -> DataFrame:
    """(path, hash, mtime, indexed_at, content) of all files that have an extractor."""
    t = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace("path", "^file:/+", "/")
    skip = "/(" + "|".join(x.replace(".", r"\.") for x in SKIPPED_FOLDERS) + ")/"
    t = t.withColumn("path", path).where(is_supported(F.col("path")) & ~F.col("path").rlike(skip))
    return t.select("path", F.sha2("content", 256).alias("hash"), F.unix_timestamp("modificationTime").alias("mtime"), F.unix_timestamp().alias("indexed_at"), "content")


def changed_files(spark: SparkSession, root: str, staged: bool = True, uncommitted: bool = True) -> DataFrame:
    """Paths that git reports as changed: a bounded list from the driver's work tree."""
    run = lambda *a: subprocess.run(["git", "-C", root, *a], capture_output=True, text=True, check=True).stdout.split("\n")
    names = run("diff", "--cached", "--name-only") if staged else []
    if uncommitted:
        names += run("diff", "--name-only", "HEAD") + run("ls-files", "--others", "--exclude-standard")
    return spark.createDataFrame([(f"{root.rstrip('/')}/{x}",) for x in sorted(set(filter(None, names)))], "file string")


def grep(sources: DataFrame, pattern: str, include: str | None = None, context: int = 0, limit: int = 50, key: str = "path", content: str = "content") -> DataFrame:
    """Lines that match, numbered from 1, with lines around them; the first ``limit`` by place."""
    from ..functions.text import glob_match

    s = sources.where(glob_match(F.substring_index(key, "/", -1), include)) if include else sources
    lines = s.select(key, F.posexplode(F.split(content, "\n")).alias("i", "line")).select(key, (F.col("i") + 1).cast("long").alias("line_no"), "line")
    hits = lines.where(F.col("line").rlike(pattern))
    if context:
        near = hits.select(key, F.explode(F.sequence(F.col("line_no") - context, F.col("line_no") + context)).alias("line_no")).distinct()
        hits = lines.join(near, [key, "line_no"], "left_semi")
    return hits.orderBy(key, "line_no").limit(limit)


def find_files(files: DataFrame, pattern: str, limit: int = 50, key: str = "path") -> DataFrame:
    from ..functions.text import glob_match

    return files.where(glob_match(F.substring_index(key, "/", -1), pattern)).select(key).orderBy(key).limit(limit)


def read_range(sources: DataFrame, first: int, last: int, most: int = 200, key: str = "path", content: str = "content") -> DataFrame:
    """Numbered lines of a range, at most ``most``."""
    n = min(last - first + 1, most)
    lines = F.slice(F.split(content, "\n"), first, n)
    return sources.select(key, F.array_join(F.transform(lines, lambda x, i: F.concat(F.lpad((i + first).cast("string"), 5, " "), F.lit(" "), x)), "\n").alias("text"))


def latest_results(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """Result files with their time, newest first."""
    t = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return t.select("path", "modificationTime").orderBy(F.desc("modificationTime"), "path")
