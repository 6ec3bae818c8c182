"""Connected components of a table of links, without gathering them anywhere."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_batches, stored

#: Links that a task joins at once before rounds begin.
LINKS = 1 << 16


def forest(links: DataFrame) -> DataFrame:
    """Links (u, v), u > v, of the same components: of each ``LINKS`` that a task reads, one a node.

    Links within a group of near copies are many more than its members; a task keeps those that
    join something that its others have not joined, as links to the smallest node.
    """

    def run(batches):
        up, n = {}, 0

        def root(x):
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        for batch in batches:
            for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
                u, v = root(u), root(v)
                if u != v:
                    up[max(u, v)] = min(u, v)
            n += batch.num_rows
            types = batch.schema
            if n >= LINKS:
                yield told(up, root, types)
                up.clear()
                n = 0
        if up:
            yield told(up, root, types)

    def told(up, root, types):
        rows = [(x, y) for x in up if (y := root(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], types.field(k).type) for k in (0, 1)], names=["u", "v"])

    return map_batches(links, run, links.schema)


def _is_solved(links: DataFrame) -> bool:
    """Whether every node has one link, to a node that has none: no round would change anything."""
    if not links.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return False
    return links.select("v").distinct().join(links.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``links``; the component is its smallest node.

    Alternates two steps that replace links by links to smaller nodes: each node sends its larger
    neighbours to its smallest neighbour, then its smaller ones. Neighbour lists are never
    gathered: the smallest neighbour is an aggregate that is joined back, so that a node with a
    very large number of links is spread over many tasks. The rounds end when every link leads to
    a node that has no smaller one; each step is a stored table, and the last one can be given to
    ``discard``.
    """
    spark = links.sparkSession
    now = stored(forest(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v")).distinct(), "links")
    while not _is_solved(now):
        # large star: over all neighbours of u, link the larger ones to the smallest of u and them
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("w"))
        least = least.select(F.col("u").alias("x"), F.least("u", "w").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.distinct(), "links")
        # small star: link u and its smaller neighbours to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), "m")
        small = large.join(least, large.u == least.x).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("l")).select("l.*")
        new = stored(small.where("u > v").distinct(), "links")
        discard(spark, now, large)
        now = new
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
    out._stored_at = now._stored_at
    return out
