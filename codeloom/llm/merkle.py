"""A Merkle manifest of a table: one tree a group, one tree over the groups' roots, proofs for all rows.

Rows become leaves in the JVM; only digests go on. Leaves are numbered within their group by a
range sort. The trees are built by Pregel-style supersteps over RDDs: a vertex is a block of up to
``fan_out ** DEPTH`` neighbouring nodes; in each superstep children message their block, a block
that has all its children folds them to one node, a level at a time, and sends that to the block
above. The roots of the groups are the leaves of a last tree. Reverse supersteps send the sibling
path of each block down, until each leaf has its own and is folded up to a root again.

A block folds DEPTH levels, so 10 ** 12 leaves take four supersteps up and four down; all levels
above the leaves' blocks carry less than a thousandth of the rows. Lost executors only repeat
supersteps from the stored leaves.

Edge cases: a null value is ``-``, a null group is a group that comes first, null keys come first;
rows that share a key are ordered by their digest, and rows that are equal are leaves of their own;
an empty table has no rows; columns not named are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ordered_parts, partitions, stored

#: Columns of a leaf, in their order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels that a block folds; nodes that become one.
DEPTH, FAN_OUT = 10, 2
#: Blocks of a task, while there are fewer than that for each of the session's partitions.
BLOCKS = 16

MANIFEST = "key long, leaf string, position long, subroot string, root string, siblings array<string>, folded_root string"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(encoded, values)), 256)


def numbered(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The leaves (tree, position, n, key, leaf, claim), and the trees (tree, n), numbered in the
    order of their groups.

    The rows of one group may lie in any number of ranges; what they must know of it is joined by
    range and group, of which there are at most as many as ranges and groups.
    """
    rows = stored(leaves.select("grp", "key", "leaf", "claim", F.monotonically_increasing_id().alias("tie")), "merkle-leaves")
    rows = ordered_parts(rows, [F.asc_nulls_first("grp"), F.asc_nulls_first("key"), "leaf", "tie"], "merkle-order")
    own = rows.groupBy("part", "grp").agg(F.min("g").alias("start"), F.count("*").alias("n"))
    groups = own.groupBy("grp").agg(F.min("start").alias("start"), F.sum("n").alias("n"))
    groups = ordered_parts(groups, [F.asc_nulls_first("grp")], "merkle-groups").select("grp", "start", "n", F.col("g").alias("tree"))
    # two steps, so that a group in very many ranges is no hot key of the leaves
    told = own.select("part", F.col("grp").alias("_grp")).join(groups, F.col("_grp").eqNullSafe(F.col("grp"))).select(F.col("part").alias("_part"), "_grp", "start", "n", "tree")
    same = (F.col("part") == F.col("_part")) & F.col("grp").eqNullSafe(F.col("_grp"))
    rows = rows.join(told, same).select("tree", (F.col("g") - F.col("start")).alias("position"), "n", "key", "leaf", "claim")
    return rows, groups.select("tree", "n")


def height(n: int, fan_out: int) -> int:
    """Levels from ``n`` nodes to one."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fan_out), levels + 1
    return levels


def folded(nodes: list[str], levels: int, fan_out: int) -> list[list[str]]:
    """The nodes and the levels above them: each run of ``fan_out`` becomes one, a shorter last run too."""
    out = [nodes]
    for _ in range(levels):
        nodes = [sha("".join(nodes[i : i + fan_out])) for i in range(0, len(nodes), fan_out)]
        out.append(nodes)
    return out


def path(levels: list[list[str]], i: int, fan_out: int) -> list[tuple[int, list[str]]]:
    """For each level but the last the place of the node above child ``i`` in its run, and the run's others."""
    out = []
    for nodes in levels[:-1]:
        first = i - i % fan_out
        out.append((i - first, nodes[first:i] + nodes[i + 1 : first + fan_out]))
        i //= fan_out
    return out


def climbed(digest: str, steps: list[tuple[int, list[str]]]) -> str:
    """The root above a leaf, from its digest and its siblings."""
    for place, others in steps:
        digest = sha("".join([*others[:place], digest, *others[place:]]))
    return digest


class Trees:
    """Trees over messages ((tree, block), (place in the block, nodes of the level, digest, load)).

    ``levels`` are the vertices of each superstep: ((tree, block), (nodes of the level, children)).
    """

    def __init__(self, leaves: RDD, most: int, total: int, parts: int, fan_out: int = FAN_OUT, depth: int = DEPTH):
        self.fan_out, self.depth, self.width = fan_out, depth, fan_out**depth
        self.levels: list[RDD] = []
        self.roots: RDD | None = None
        messages = leaves
        while True:
            total = -(-total // self.width)
            done = self._completed(messages, min(parts, 1 + total // BLOCKS))
            self.levels.append(done)
            roots = done.flatMap(self._root(len(self.levels) - 1))
            self.roots = roots if self.roots is None else self.roots.union(roots)
            if most <= self.width:
                break
            messages, most = done.flatMap(self._forwarded()), -(-most // self.width)

    def _completed(self, messages: RDD, parts: int) -> RDD:
        """Superstep: blocks with all their children, in order."""
        width = self.width

        def complete(kv):
            (tree, block), sent = kv
            children = sorted(sent, key=lambda c: c[0])
            n = children[0][1]
            if len(children) != min(width, n - block * width):
                raise ValueError(f"block {block} of tree {tree} has {len(children)} of its children")
            return (tree, block), (n, [(digest, load) for _, _, digest, load in children])

        return messages.groupByKey(parts).map(complete, preservesPartitioning=True)

    def _levels(self, n: int, children: list) -> list[list[str]]:
        return folded([digest for digest, _ in children], self.depth if n > self.width else height(n, self.fan_out), self.fan_out)

    def _root(self, level: int):
        return lambda v: [(v[0][0], (level, self._levels(*v[1])[-1][0]))] if v[1][0] <= self.width else []

    def _forwarded(self):
        """The message of a block to the one above it; none from a root."""

        def send(v):
            (tree, block), (n, children) = v
            if n > self.width:
                yield (tree, block // self.width), (block % self.width, -(-n // self.width), self._levels(n, children)[-1][0], None)

        return send

    def __getstate__(self):
        return {"fan_out": self.fan_out, "depth": self.depth, "width": self.width}

    def told(self, above: RDD) -> RDD:
        """Reverse supersteps: (load, digest, what the tree was told, path) of each leaf.

        ``above`` has (tree, (level of its root, (anything, the path above its root))).
        """
        messages = None
        for level in range(len(self.levels) - 1, -1, -1):
            here = above.flatMap(lambda a, level=level: [((a[0], 0), a[1][1])] if a[1][0] == level else [])
            messages = here if messages is None else messages.union(here)
            vertices = self.levels[level]
            parts = vertices.getNumPartitions()
            both = vertices.join(messages.partitionBy(parts), parts)
            messages = both.flatMap(self._down(leaves=level == 0))
        return messages

    def _down(self, leaves: bool):
        def send(v):
            (tree, block), ((n, children), (about, upper)) = v
            levels = self._levels(n, children)
            for i, (digest, load) in enumerate(children):
                steps = path(levels, i, self.fan_out) + upper
                yield (load, digest, about, steps) if leaves else ((tree, block * self.width + i), (about, steps))

        return send


def manifest(leaves: DataFrame, fan_out: int = FAN_OUT, depth: int = DEPTH) -> DataFrame:
    """One row a leaf: key, leaf, position in its group, subroot, root, siblings on the way to the
    root, and folded_root, the root that ``claim`` (else the leaf) gives with these siblings.

    ``leaves`` has grp, key (long), leaf and claim (hex digests; a null claim is the leaf).
    """
    spark = leaves.sparkSession
    rows, trees = numbered(leaves)
    size = trees.agg(F.max("n"), F.sum("n"), F.count("*")).first()
    if not size[2]:
        return spark.createDataFrame([], MANIFEST)
    width, parts = fan_out**depth, partitions(spark)
    sent = rows.rdd.map(lambda r: ((r[0], r[1] // width), (r[1] % width, r[2], r[4], (r[3], r[1], r[5]))))
    low = Trees(sent, size[0], size[1], parts, fan_out, depth)
    n = size[2]
    tops = low.roots.map(lambda t: ((0, t[0] // width), (t[0] % width, n, t[1][1], (t[0], t[1][0]))))
    high = Trees(tops, n, n, parts, fan_out, depth)
    roots = high.roots.map(lambda t: (t[0], (t[1][0], (t[1][1], []))))
    above = high.told(roots).map(lambda t: (t[0][0], (t[0][1], ((t[1], t[2]), t[3]))))

    def row(t):
        (key, position, claim), digest, (subroot, root), steps = t
        return key, digest, position, subroot, root, [x for _, others in steps for x in others], climbed(claim or digest, steps)

    return spark.createDataFrame(low.told(above).map(row), MANIFEST, verifySchema=False)


def document_leaves(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, group: str = "lang", key: str = "doc_id", changed: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """(grp, key, leaf, claim): the leaves of a table; rows of ``where`` claim the leaf that they
    have with the columns ``changed``."""
    values = [F.col(c) for c in columns]
    claim = F.when(where, leaf([(changed or {}).get(c, v) for c, v in zip(columns, values, strict=True)])) if where is not None else F.lit(None).cast("string")
    return docs.select(F.col(group).cast("string").alias("grp"), F.col(key).cast("long").alias("key"), leaf(values).alias("leaf"), claim.alias("claim"))


def verified_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of documents, held against rows of which about a seventh have one more in n_chars."""
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    leaves = document_leaves(docs, changed={"n_chars": F.coalesce(F.try_add(F.col("n_chars"), F.lit(1)), "n_chars")}, where=tampered)
    proof = F.sha2(F.array_join("siblings", ""), 256)
    return manifest(leaves).select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
