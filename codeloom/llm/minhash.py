"""Near duplicates by MinHash with tensored banding.

Two small collections of sketches are computed, each sketch from a few minhashes; the table keys
are all pairs of a sketch from one and a sketch from the other, so that T * T tables need only
2 * T sketches. A pair of texts with similarity s meets unless it shares no sketch of one of the
collections: 2 * (1 - s ** R) ** T at most, for R = 3 and T = 14 under 0.001 at s = 0.75 and
under 0.0001 at s = 0.8. Candidates are verified on the full shingle sets.

Documents with the same set are one class from the start, so exact copies cost one row. A sketch
that only one class has cannot make a pair and is dropped before keys are formed. Tables are
never expanded into all pairs. Classes that share a sketch with many others are first compared with
one class of these, which joins large groups of near copies by one pair a class. Buckets that are
one component then need nothing more; of the others, a small one gives its pairs, a large one
compares every member with its first, and members still in different components are compared with
all others exactly, in blocks.

Edge cases: null and empty texts have an empty set and are linked with nothing; fewer than five
words are one shingle; rows that repeat a text are one class whatever their ids; a null id is
never a component's smallest unless all are null; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_sizes, discard, map_batches, partitions, pieces, rows_out, stored, unused
from .components import components
from .decontamination import WordHashes, word_hashes

#: Words in a shingle, similarity in percent.
SHINGLE, PERCENT = 5, 75
#: Sketches in a collection, minhashes in a sketch.
T, R = 14, 3
#: Buckets up to this size give all their pairs.
SMALL = 24
#: Bytes of sets in a block of queries and in a share of members, when what large buckets leave is
#: compared; bytes of text or sets worked on at once.
QUERIES, MEMBERS, CHUNK = 1 << 20, 1 << 22, 1 << 18

_FACTORS = (np.arange(3, 3 + SHINGLE, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingles(text: str | None, known: WordHashes) -> np.ndarray:
    """The sorted set of shingle hashes of a text."""
    h = word_hashes(text, known)
    n = len(h)
    if not n:
        return np.zeros(0, np.uint64)
    width = min(n, SHINGLE)
    out = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        out += h[k : n - width + 1 + k] * _FACTORS[k]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return np.unique(out ^ (out >> np.uint64(32)))


@lru_cache(maxsize=1)
def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(9)
    n = 2 * T * R
    return rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, np.uint64)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """2 * T sketches for each set that is not empty; one row a set."""
    out = np.zeros((len(sets), 2 * T), np.int64)
    some = [i for i, s in enumerate(sets) if len(s)]
    if not some:
        return out
    every = np.concatenate([sets[i] for i in some])
    at = np.concatenate(([0], np.cumsum([len(sets[i]) for i in some])[:-1]))
    a, b = _functions()
    mixed = np.zeros(len(some), np.uint64)
    for k in range(2 * T * R):
        x = every * a[k] + b[k]
        x ^= x >> np.uint64(31)
        low = np.minimum.reduceat(x, at)
        mixed = (mixed if k % R else np.zeros(len(some), np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + low
        mixed ^= mixed >> np.uint64(29)
        if k % R == R - 1:
            out[some, k // R] = mixed.view(np.int64)
    return out


_SIGNED = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("cls", pa.binary()), ("sketch", pa.list_(pa.int64()))])


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, h (hash of the text), n (set size), cls (hash of the set), sketch."""

    def run(batches):
        import xxhash

        known = WordHashes()
        for batch in batches:
            texts = batch.column("text")
            for i, j in pieces(byte_sizes(texts), CHUNK):
                sets = [shingles(x, known) for x in texts.slice(i, j - i).to_pylist()]
                rows = sketches(sets)
                yield rows_out({"doc_id": batch.column("id").slice(i, j - i), "h": batch.column("h").slice(i, j - i), "n": [len(s) for s in sets], "cls": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], "sketch": list(rows)}, _SIGNED)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    return map_batches(rows, run, "doc_id long, h long, n long, cls binary, sketch array<long>")


def sketch_rows(classes: DataFrame) -> DataFrame:
    """(k, slot, cls, n): the sketches of each class; k names the slot and the value."""
    parts = classes.select("cls", "n", F.posexplode("sketch").alias("slot", "h"))
    return parts.select(F.xxhash64("slot", "h").alias("k"), "slot", "cls", "n")


def table_keys(mine: DataFrame) -> DataFrame:
    """(key, cls, n): all pairs of a sketch of the first collection and one of the second."""
    both = mine.groupBy("cls", "n").agg(F.collect_list(F.struct("slot", "k")).alias("s"))
    side = lambda low: F.filter("s", lambda x: (x["slot"] < T) if low else (x["slot"] >= T))
    keys = both.select("cls", "n", F.explode(side(True)).alias("a"), side(False).alias("bs")).select("cls", "n", "a", F.explode("bs").alias("b"))
    return keys.select(F.xxhash64("a.k", "b.k").alias("key"), "cls", "n")


def _near_in_size(n: Column, m: Column) -> Column:
    return 100 * F.least(n, m) >= PERCENT * F.greatest(n, m)


def to_first(rows: DataFrame) -> DataFrame:
    """(a, b): each class with the smallest of the first members (column first) of its buckets."""
    rows = rows.where((F.col("cls") > F.col("first.cls")) & _near_in_size(F.col("n"), F.col("first.n")))
    return rows.groupBy("cls").agg(F.min("first")["cls"].alias("a")).select("a", F.col("cls").alias("b"))


def small_pairs(rows: DataFrame) -> DataFrame:
    """(a, b): all pairs of small buckets whose members are in different components so far."""
    lists = rows.where(F.col("size") <= SMALL).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("cls", "n", "c"))).alias("s"))
    pairs = lists.select(F.posexplode("s").alias("i", "x"), "s").select("x", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("y"))
    return pairs.where((F.col("x.c") != F.col("y.c")) & _near_in_size(F.col("x.n"), F.col("y.n"))).select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b"))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets are similar enough."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(y) < len(x):
                    x, y = y, x
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one, two = sets.select(F.col("cls").alias("a"), F.col("set").alias("x")), sets.select(F.col("cls").alias("b"), F.col("set").alias("y"))
    return map_batches(pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y"), run, "a binary, b binary")


def shingle_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(cls, set) of the classes in ``wanted`` (cls, doc_id): only their texts are exchanged."""

    def run(batches):
        import xxhash

        known = WordHashes()
        for batch in batches:
            for i, j in pieces(byte_sizes(batch.column("text")), CHUNK):
                part = batch.slice(i, j - i)
                sets = [shingles(x, known).tobytes() for x in part.column("text").to_pylist()]
                own = pa.array([xxhash.xxh3_128_digest(x) == c for x, c in zip(sets, part.column("cls").to_pylist(), strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column("cls"), pa.array(sets, pa.binary())], names=["cls", "set"]).filter(own)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = texts.join(wanted, texts.doc_id.eqNullSafe(wanted.doc_id)).select("cls", "text")
    return map_batches(rows, run, "cls binary, set binary")


def families(rest: DataFrame) -> DataFrame:
    """(cls, family): buckets that share members are one family.

    A class gives one link, to the smallest first member of its buckets; its other first members
    are linked with that one, and of these links only the different ones count.
    """
    pairs = stored(rest.select("cls", F.col("first.cls").alias("f")).distinct(), "family-links")
    least = pairs.groupBy("cls").agg(F.min("f").alias("f0"))
    links = least.select(F.col("f0").alias("a"), F.col("cls").alias("b")).union(pairs.join(least, "cls").select("f0", "f").distinct())
    out = components(links)
    discard(rest.sparkSession, pairs)
    return out


def block_links(rest: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between members of large buckets that are in different components.

    In each family, the members outside its largest component are the queries; they are compared
    with all members, exactly, in blocks: a task has a block of queries as one sorted list of
    shingles, and runs a share of the members through it. Blocks and shares are cut by bytes.
    """
    spark = rest.sparkSession
    family = families(rest)
    members = rest.select("cls", "c", "n").distinct().join(family.select(F.col("node").alias("cls"), F.col("component").alias("family")), "cls")
    of = members.groupBy("family", "c").agg(F.count("*").alias("count"), F.sum("n").alias("n")).groupBy("family")
    top = of.agg(F.max(F.struct("count", "c", "n")).alias("top"), F.sum("n").alias("n"))
    shares = top.select("family", F.col("top.c").alias("top"), F.ceil(8 * (F.col("n") - F.col("top.n")) / QUERIES).cast("int").alias("blocks"), F.ceil(8 * F.col("n") / MEMBERS).cast("int").alias("shares")).where("blocks > 0")
    members = stored(members.join(shares, "family").join(sets, "cls").withColumn("h", F.xxhash64("cls")), "members")
    discard(spark, family)
    queries = members.where("c <> top").select("family", F.pmod("h", "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(0).alias("role"), "cls", "c", "set")
    others = members.select("family", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.shiftright("h", 20), F.col("shares").cast("long")).cast("int").alias("share"), F.lit(1).alias("role"), "cls", "c", "set")
    key = ["family", "block", "share"]

    def run(batches):
        now, queries, index, joined = None, [], None, set()
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                k = (r["family"], r["block"], r["share"])
                if k != now:
                    now, queries, index, joined = k, [], None, set()
                own = np.frombuffer(r["set"], np.uint64)
                if r["role"] == 0:
                    queries.append((r["cls"], r["c"], own))
                    continue
                if not queries:
                    continue
                if index is None:
                    size = np.array([len(q[2]) for q in queries])
                    every = np.concatenate([q[2] for q in queries])
                    of = np.repeat(np.arange(len(queries)), size)
                    order = np.argsort(every, kind="stable")
                    index = every[order], of[order], size
                every, of, size = index
                lo, hi = np.searchsorted(every, own, "left"), np.searchsorted(every, own, "right")
                n = hi - lo
                at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - lo, n)
                both = np.bincount(of[at], minlength=len(queries))
                for q in np.flatnonzero(100 * both >= PERCENT * (size + len(own) - both)).tolist():
                    # one link of a query to a component joins the two; more would say the same
                    if queries[q][1] != r["c"] and (q, r["c"]) not in joined:
                        joined.add((q, r["c"]))
                        out.append((queries[q][1], r["c"]))
            out = list(set(out))
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.binary()), "b": pa.array([y for _, y in out], pa.binary())})

    dealt = queries.union(others).repartition(partitions(spark), *key).sortWithinPartitions(*key, "role")
    out = stored(map_batches(dealt, run, "a binary, b binary").distinct(), "verified")
    discard(spark, members)
    return out


def extended(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, component) after more links: only components that they join are visited."""
    named = lambda x: found.select(F.col("node").alias(f"{x}_node"), F.col("component").alias(f"{x}_of"))
    told = links.join(named("a"), F.col("a") == F.col("a_node"), "left").join(named("b"), F.col("b") == F.col("b_node"), "left")
    told = told.select(F.coalesce("a_of", "a").alias("a"), F.coalesce("b_of", "b").alias("b")).where("a <> b")
    more = components(told)
    also = more.select(F.col("node").alias("old"), F.col("component").alias("new"))
    out = found.join(also, F.col("component") == F.col("old"), "left").select("node", F.coalesce("new", "component").alias("component"))
    out = stored(out.union(more.join(found.select("node"), "node", "left_anti")), "components")
    discard(found.sparkSession, more)
    return out


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row a document: doc_id, h (hash of the text), n (set size), component_id; stored."""
    spark = docs.sparkSession
    signed = stored(signatures(docs, id_col, text_col), "signatures")
    some = signed.where("n > 0")
    classes = some.groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = stored(classes, "classes")

    def sets_of(wanted: DataFrame) -> DataFrame:
        wanted = classes.select("cls", "doc_id").join(wanted, "cls", "left_semi")
        return stored(shingle_sets(docs, wanted, id_col, text_col), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        sets = sets_of(pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct())
        out = stored(verified(pairs, sets.dropDuplicates(["cls"])), "verified")
        discard(spark, sets)
        return out

    def with_component(rows: DataFrame, found: DataFrame) -> DataFrame:
        return rows.join(found, F.col("cls") == F.col("node"), "left").select("key", "cls", "n", F.coalesce("component", "cls").alias("c"))

    # large groups first: classes that share a sketch with many, each with the first of one of these
    parts = sketch_rows(classes)
    shared = parts.groupBy("k").agg(F.count("*").alias("size"), F.min(F.struct("cls", "n")).alias("first")).where("size > 1")
    mine = stored(parts.join(shared, "k"), "sketches")
    tried = stored(to_first(mine.where(F.col("size") > SMALL)), "pairs")
    links = confirmed(tried)
    first = components(links)

    # tables: only buckets whose members are not one component yet
    buckets = with_component(table_keys(mine.select("k", "slot", "cls", "n")), first)
    open_keys = lambda t: t.groupBy("key").agg(F.count("*").alias("size"), F.min("c").alias("low"), F.max("c").alias("high"), F.min(F.struct("cls", "n")).alias("first")).where("low <> high").drop("low", "high")
    rows = stored(buckets.join(open_keys(buckets), "key"), "buckets")
    discard(spark, mine, links)
    large = rows.where(F.col("size") > SMALL)
    pairs = small_pairs(rows).union(to_first(large)).distinct().join(tried, ["a", "b"], "left_anti")
    pairs = stored(pairs, "pairs")
    links = confirmed(pairs)
    found = extended(first, links)
    discard(spark, first, tried, pairs, links)

    # what large buckets leave: members in different components that no pair has compared
    rest = with_component(large.select("key", "cls", "n"), found)
    rest = stored(rest.join(open_keys(rest).select("key", "first"), "key"), "rest")
    discard(spark, rows)
    if not rest.isEmpty():
        sets = sets_of(rest.select("cls").distinct())
        links = block_links(rest, sets.dropDuplicates(["cls"]))
        before, found = found, extended(found, links)
        discard(spark, sets, links, before)
    named = classes.select("cls", "doc_id").join(found, F.col("cls") == F.col("node"), "left").select("cls", "doc_id", F.coalesce("component", "cls").alias("c"))
    least = named.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "c").select("cls", "component_id")
    out = signed.select("doc_id", "h", "n", F.when(F.col("n") > 0, F.col("cls")).alias("k")).join(named, F.col("k") == F.col("cls"), "left")
    out = stored(out.select("doc_id", "h", "n", F.coalesce("component_id", "doc_id").alias("component_id")), "groups")
    discard(spark, signed, classes, rest, found)
    return out


def _is_kept() -> Column:
    return F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept."""
    return _grouped(docs, id_col, text_col).select("doc_id", F.col("n").alias("n_shingles"), "component_id", _is_kept().alias("kept"))


def kept_documents(docs: DataFrame) -> DataFrame:
    """One document of each group, with the columns of ``docs``; rows that repeat an id and a text stay once."""
    names = unused(docs, "_id", "_text")
    doc_id = F.col("doc_id").cast("long")

    def keyed(rows: DataFrame, h: Column) -> DataFrame:
        return rows.select("*", F.coalesce(doc_id, F.lit(0)).alias(names[0]), F.xxhash64(doc_id.isNull(), h).alias(names[1]))

    kept = keyed(_grouped(docs, "doc_id", "text").where(_is_kept()), F.col("h")).select(names)
    # joined and reduced on the same two columns: one exchange of the texts
    return keyed(docs, F.xxhash64("text")).join(kept, names, "left_semi").dropDuplicates(names).select(docs.columns)
