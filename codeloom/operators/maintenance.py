"""Keeping the index tables in step with files: replace, remove, prune, resolve again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def replaced(table: DataFrame, new: DataFrame, file: str = "file") -> DataFrame:
    """All rows of the files in ``new`` give way to the new rows."""
    return table.join(new.select(file).distinct(), file, "left_anti").unionByName(new)


def without_files(tables: dict[str, DataFrame], removed: DataFrame) -> dict[str, DataFrame]:
    """Every table without the removed files (column path); dependencies lose both sides."""
    gone = removed.select("path").distinct()
    columns = {"files": ["path"], "symbols": ["file"], "references": ["file"], "bindings": ["file"], "dependencies": ["from_file", "to_file"], "sources": ["path"]}
    out = {}
    for name, t in tables.items():
        for c in columns.get(name, []):
            t = t.join(gone.select(F.col("path").alias(c)), c, "left_anti")
        if name == "edges":  # an edge belongs to the file before the mark in its source's id
            t = t.withColumn("_f", F.regexp_extract("src", r"^(.*)#", 1)).join(gone.select(F.col("path").alias("_f")), "_f", "left_anti").drop("_f")
        out[name] = t
    return out


def pruned(known: DataFrame, seen: DataFrame, key: str = "path") -> DataFrame:
    """Known files that a scan did not see."""
    return known.join(seen.select(key), key, "left_anti")


def latest_changes(changes: DataFrame) -> DataFrame:
    """The last operation on each path of a change feed (path, op, seq)."""
    return changes.groupBy("path").agg(F.max(F.struct("seq", "op")).alias("c")).select("path", "c.op", "c.seq")


def meta_set(meta: DataFrame, key: str, value: str) -> DataFrame:
    """The table of (key, value) with one value set."""
    row = meta.sparkSession.createDataFrame([(key, value)], "key string, value string")
    return meta.where(F.col("key") != key).unionByName(row)


def meta_get(meta: DataFrame, key: str) -> DataFrame:
    return meta.where(F.col("key") == key).select("value")


def meta_delete(meta: DataFrame, key: str) -> DataFrame:
    return meta.where(F.col("key") != key)


def ready(meta: DataFrame) -> bool:
    """Whether the first indexing is complete, by its mark in the meta table."""
    return not meta_get(meta, "initial_index_complete").where("value = 'true'").isEmpty()


def analyzed(spark: SparkSession, name: str) -> None:
    """Statistics of a catalogue table and its columns, for the optimizer."""
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR ALL COLUMNS")


def schema_state(found: str | None, current_version: str) -> str:
    """``missing``, ``ok``, ``older`` or ``newer`` major, by the recorded version."""
    if not found:
        return "missing"
    a, b = (tuple(int(x) for x in v.split(".")) for v in (found, current_version))
    return "ok" if a[0] == b[0] else "older" if a < b else "newer"
