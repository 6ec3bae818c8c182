"""N-gram Jaccard join with adaptive prefixes that must match more than once.

Each text is the set of its distinct shingles; two texts link at PERCENT of Jaccard similarity. All
shingles stand in one global order, rare ones first (counts by hash bucket over the whole corpus,
a table of fixed size). Texts that link have an overlap of ``need = ceil(PERCENT * n / 100)``
shingles at least, so that the first ``n - need + l`` shingles of both share l of them, for every
l up to the overlap. The cost of a text's candidates at each l is estimated from the lengths of the lists
of its prefix shingles, and the l that costs least is taken: a longer prefix, and so many
shingles more that a candidate must share with it before the full sets are compared.

Texts with equal sets are one class from the start. A shingle's list is never expanded into all
pairs when it is long: its members are compared exactly, in blocks. Where that would cost more than
to read the corpus again, members of long lists are first compared with a few of their members, which joins
large groups of near copies by a link or two a class. A long list whose members are still of many groups
is of a shingle that is frequent after all: it goes to the end of the order, and the texts that
have it in their prefix take further shingles instead, until blocks are cheap, nothing changes or ROUNDS
are over. Blocks are for what is then left: near copies outside their group's component, texts made of
frequent shingles.

Edge cases: null and empty texts have an empty set and are linked with nothing; texts with fewer
words than a shingle are one shingle; rows that repeat a text are one class whatever their ids; a
null id is never a component's smallest unless all are null; ties of the order go by hash; an empty
table gives an empty result; columns not named are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import byte_sizes, discard, map_batches, partitions, pieces, rows_out, stored
from .components import components
from .decontamination import WordHashes, word_hashes
from .minhash import extended, families

#: Words in a shingle, similarity in percent.
SHINGLE, PERCENT = 3, 90
#: Shared shingles that a candidate can be asked for.
MATCHES = 3
#: Counters of shingles (four bytes each in a broadcast), those in one row of a partial count.
BUCKETS, COUNTERS = 1 << 20, 1 << 12
#: Lists up to this size give all their pairs.
SMALL = 32
#: Members that a long list is compared with; times that frequent shingles are put last.
STARS, ROUNDS = 3, 6
#: Shingles of a set that cost as much to compare as one entry of a list costs to join.
UNIT = 64
#: Long lists are worked on before blocks if these would compare more shingles than so many times
#: those of the whole corpus, and as long as that leaves at most so much of the cost.
READS, LEFT = 512, 0.75
#: Classes (about 40 bytes each) that are broadcast to find their texts; more are joined by an exchange.
FEW = 50_000
#: Pairs with one set that one task compares; bytes of sets in a block and in a share of members;
#: bytes of text worked on at once.
PAIRS, QUERIES, MEMBERS, CHUNK = 4096, 1 << 20, 1 << 22, 1 << 18

_FACTORS = (np.arange(71, 71 + 64, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_SHIFT = np.uint64(64 - (BUCKETS.bit_length() - 1))


def shingles(text: str | None, known: WordHashes, width: int = SHINGLE) -> np.ndarray:
    """The sorted set of shingle hashes of a text."""
    h = word_hashes(text, known)
    n = len(h)
    if not n:
        return np.zeros(0, np.uint64)
    width = min(n, width)
    out = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        out += h[k : n - width + 1 + k] * _FACTORS[k]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return np.unique(out ^ (out >> np.uint64(32)))


def sets_in(batch: pa.RecordBatch, known: WordHashes):
    """(first row, end, sets) of pieces of a batch."""
    texts = batch.column("text")
    for i, j in pieces(byte_sizes(texts), CHUNK):
        yield i, j, [shingles(x, known) for x in texts.slice(i, j - i).to_pylist()]


def shingle_counts(texts: DataFrame) -> np.ndarray:
    """How many sets have a shingle of each bucket, over all rows; at most 2 ** 32 - 1."""

    def count(batches):
        known, total = WordHashes(), np.zeros(BUCKETS, np.uint32)
        for batch in batches:
            for _, _, sets in sets_in(batch, known):
                total += np.bincount((np.concatenate(sets) >> _SHIFT).astype(np.int64), minlength=BUCKETS).astype(np.uint32)
        some = [k for k in range(0, BUCKETS, COUNTERS) if total[k : k + COUNTERS].any()]
        yield pa.RecordBatch.from_pydict({"k": pa.array(some, pa.int32()), "counts": pa.array([total[k : k + COUNTERS].tobytes() for k in some], pa.binary())})

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, counts in zip(batch.column("k").to_pylist(), batch.column("counts"), strict=True):
                mine = sums.setdefault(k, np.zeros(COUNTERS, np.uint64))
                mine += np.frombuffer(counts.as_buffer(), np.uint32)
        out = [np.minimum(x, np.uint64(2**32 - 1)).astype(np.uint32).tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_pydict({"k": pa.array(list(sums), pa.int32()), "counts": pa.array(out, pa.binary())})

    out = np.zeros(BUCKETS, np.uint32)
    # at most BUCKETS / COUNTERS rows, 4 * BUCKETS bytes
    for k, counts in map_batches(map_batches(texts, count, "k int, counts binary").repartition("k"), add, "k int, counts binary").collect():
        out[k : k + COUNTERS] = np.frombuffer(counts, np.uint32)
    return out


def least_overlap(n: int) -> int:
    return -(-PERCENT * n // 100)


def prefix(own: np.ndarray, counts: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The shingles of a set that can be in its longest prefix, in the global order; those of ``last`` stand last."""
    rank = counts[(own >> _SHIFT).astype(np.int64)].astype(np.int64)
    if len(last):
        rank[np.isin(own, last)] += 1 << 33
    return own[np.argsort(rank, kind="stable")[: len(own) - least_overlap(len(own)) + MATCHES]]


def _class(own: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(own.tobytes())


_SIGNED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("cls", pa.binary()), ("tokens", pa.list_(pa.int64()))])


def signatures(texts: DataFrame, counts) -> DataFrame:
    """doc_id, n (set size), cls (hash of the set), tokens (its longest prefix)."""

    def run(batches):
        known, none = WordHashes(), np.zeros(0, np.uint64)
        for batch in batches:
            for i, j, sets in sets_in(batch, known):
                yield rows_out({"doc_id": batch.column("doc_id").slice(i, j - i), "n": [len(s) for s in sets], "cls": [_class(s) for s in sets], "tokens": [prefix(s, counts.value, none).view(np.int64) for s in sets]}, _SIGNED)

    return map_batches(texts, run, "doc_id long, n long, cls binary, tokens array<long>")


def of_classes(texts: DataFrame, wanted: DataFrame, f, schema: str, *columns: str, few: bool = False) -> DataFrame:
    """``f`` (set, row of ``columns``) of the set of each class of ``wanted`` (cls, doc_id and
    ``columns``): only the texts of these documents are exchanged, none if there are ``few``."""
    fields = ["cls", *columns]

    def run(batches):
        known, names = WordHashes(), None
        for batch in batches:
            for i, j, sets in sets_in(batch, known):
                rows = batch.slice(i, j - i).select(fields).to_pylist()
                out = [f(s, r) for s, r in zip(sets, rows, strict=True) if _class(s) == r["cls"]]
                if out:
                    names = names or list(out[0])
                    yield pa.RecordBatch.from_pylist(out)

    wanted = wanted.withColumnRenamed("doc_id", "_id")
    if few:
        wanted = F.broadcast(wanted)
    rows = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")))
    # rows that share an id and a text would give a class twice
    return map_batches(rows.select("text", *fields), run, schema).dropDuplicates(["cls"])


def shingle_sets(texts: DataFrame, wanted: DataFrame, few: bool = False) -> DataFrame:
    """(cls, set) of the classes in ``wanted`` (cls, doc_id)."""
    return of_classes(texts, wanted, lambda s, r: {"cls": r["cls"], "set": s.tobytes()}, "cls binary, set binary", few=few)


def postings(classes: DataFrame) -> DataFrame:
    """(t, cls, n, grp): each shingle of a class's prefix; it counts for prefixes of grp matches and more."""
    rows = classes.select("cls", "n", F.posexplode("tokens").alias("at", "t"))
    need = F.ceil(PERCENT * F.col("n") / 100)
    return rows.select("t", "cls", "n", F.greatest(F.lit(1), F.col("at") - (F.col("n") - need) + 1).cast("int").alias("grp"))


def _near_in_size(n: Column, m: Column) -> Column:
    return 100 * F.least(n, m) >= PERCENT * F.greatest(n, m)


def with_component(rows: DataFrame, found: DataFrame) -> DataFrame:
    return rows.join(found, F.col("cls") == F.col("node"), "left").withColumn("c", F.coalesce("component", "cls")).drop("node", "component")


def star(rows: DataFrame, k: int) -> DataFrame:
    """(a, b): each class of a long list with one member of one of its lists, another one for each k."""
    centre = rows.groupBy("t").agg(F.min(F.struct(F.xxhash64("cls", F.lit(k)).alias("h"), "cls", "n", "c"))["h"].alias("h"), F.min_by(F.struct("cls", "n", "c"), F.struct(F.xxhash64("cls", F.lit(k)), "cls")).alias("first"), F.min("c").alias("low"), F.max("c").alias("high"))
    far = rows.join(centre.where("low <> high"), "t").where((F.col("c") != F.col("first.c")) & _near_in_size(F.col("n"), F.col("first.n")))
    pairs = far.groupBy("cls").agg(F.min(F.struct("h", "first"))["first"]["cls"].alias("a"))
    return pairs.select(F.least("a", "cls").alias("a"), F.greatest("a", "cls").alias("b")).distinct()


def frequent(rows: DataFrame) -> DataFrame:
    """(t): long lists in which no component has half of the members."""
    parts = rows.groupBy("t", "c").agg(F.count("*").alias("n")).groupBy("t").agg(F.max("n").alias("top"), F.sum("n").alias("size"))
    return parts.where("2 * top <= size").select("t")


def candidates(rows: DataFrame) -> DataFrame:
    """(a, b): pairs that share as many prefix shingles in short lists as the more demanding of the
    two asks for; a shingle counts if it is in the prefixes of both for that many matches."""
    sums = [F.sum(F.when(F.col("grp") <= k, F.col("size") - 1).otherwise(0)) for k in range(1, MATCHES + 1)]
    by_class = rows.groupBy("cls", "n").agg(*[s.alias(f"s{k}") for k, s in enumerate(sums, 1)], F.collect_list(F.struct("t", "grp", "size")).alias("own"))
    need = F.ceil(PERCENT * F.col("n") / 100)
    costs = [F.when(need >= k, F.struct((F.col(f"s{k}") * (1 + F.col("n") / (UNIT * k))).alias("cost"), F.lit(k).alias("k"))) for k in range(1, MATCHES + 1)]
    asked = by_class.select("cls", "n", F.array_min(F.array_compact(F.array(*costs).cast("array<struct<cost: double, k: int>>")))["k"].alias("matches"), F.explode("own").alias("o")).select("o.*", "cls", "n", "matches")
    lists = asked.where(F.col("size") <= SMALL).groupBy("t").agg(F.array_sort(F.collect_list(F.struct("cls", "n", "grp", "matches"))).alias("s"))
    pairs = lists.select(F.posexplode("s").alias("i", "x"), "s").select("x", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("y"))
    asks = F.greatest("x.matches", "y.matches")
    pairs = pairs.where(_near_in_size(F.col("x.n"), F.col("y.n")) & (F.greatest("x.grp", "y.grp") <= asks))
    shared = pairs.groupBy(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).agg(F.count("*").alias("shared"), F.max(asks).alias("asks"))
    return shared.where("shared >= asks").select("a", "b")


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    if len(y) < len(x):
        x, y = y, x
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())


def similar(both: int, n: int, m: int) -> bool:
    return 100 * both >= PERCENT * (n + m - both)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough.

    The set of a goes to a task once, before the sets that it is compared with there; pairs of one
    a are dealt over as many tasks as PAIRS asks for.
    """
    shares = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS).cast("int").alias("shares"))
    own = sets.select(F.col("cls").alias("a"), "set")
    first = shares.join(own, "a").select("a", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(None).cast("binary").alias("b"), "set")
    told = pairs.join(shares, "a").withColumn("share", F.pmod(F.xxhash64("b"), "shares").cast("int"))
    rest = told.select("a", "share", "b").join(sets.withColumnRenamed("cls", "b"), "b").select("a", "share", "b", "set")

    def run(batches):
        a, own = None, None
        for batch in batches:
            out = []
            for x, b, s in zip(*(batch.column(c) for c in ("a", "b", "set")), strict=True):
                s = np.frombuffer(s.as_buffer(), np.uint64)
                if not b.is_valid:
                    # the buffer belongs to this batch, the set may be needed in the next one
                    a, own = x.as_py(), s.copy()
                elif similar(overlap(own, s), len(own), len(s)):
                    out.append((a, b.as_py()))
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.binary()), "b": pa.array([y for _, y in out], pa.binary())})

    dealt = first.union(rest).repartition(partitions(pairs.sparkSession), "a", "share").sortWithinPartitions("a", "share", F.asc_nulls_first("b"))
    return map_batches(dealt, run, "a binary, b binary")


def block_links(rest: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between members (t, cls, n, c) of long lists that are in different components.

    Lists that share members are a family. In each, the members outside its largest component are compared
    with all members, exactly: a task has a block of them as one sorted list of shingles, and runs
    a share of the members through it. Blocks and shares are cut by bytes. A task tells one link
    fewer than it joins components.
    """
    spark = rest.sparkSession
    first = rest.groupBy("t").agg(F.min(F.struct("cls", "n")).alias("first"))
    family = families(rest.join(first, "t"))
    members = rest.select("cls", "c", "n").distinct().join(family.select(F.col("node").alias("cls"), F.col("component").alias("family")), "cls")
    top = members.groupBy("family", "c").agg(F.count("*").alias("count"), F.sum("n").alias("n")).groupBy("family").agg(F.max(F.struct("count", "c", "n")).alias("top"), F.sum("n").alias("n"))
    cut = top.select("family", F.col("top.c").alias("top"), F.ceil(8 * (F.col("n") - F.col("top.n")) / QUERIES).cast("int").alias("blocks"), F.ceil(8 * F.col("n") / MEMBERS).cast("int").alias("shares")).where("blocks > 0")
    members = stored(members.join(cut, "family").join(sets, "cls").withColumn("h", F.xxhash64("cls")), "members")
    discard(spark, family)
    asked = members.where("c <> top").select("family", F.pmod("h", "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(0).alias("role"), "c", "set")
    others = members.select("family", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.shiftright("h", 20), F.col("shares").cast("long")).cast("int").alias("share"), F.lit(1).alias("role"), "c", "set")
    key = ["family", "block", "share"]

    def run(batches):
        now, queries, index, up = None, [], None, {}

        def root(x: bytes) -> bytes:
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                k = (r["family"], r["block"], r["share"])
                if k != now:
                    now, queries, index, up = k, [], None, {}
                own = np.frombuffer(r["set"], np.uint64)
                if r["role"] == 0:
                    queries.append((r["c"], own))
                    continue
                if not queries:
                    continue
                if index is None:
                    size = np.array([len(s) for _, s in queries])
                    every, of = np.concatenate([s for _, s in queries]), np.repeat(np.arange(len(queries)), size)
                    order = np.argsort(every, kind="stable")
                    index = every[order], of[order], size
                every, of, size = index
                low, high = np.searchsorted(every, own, "left"), np.searchsorted(every, own, "right")
                n = high - low
                at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - low, n)
                both = np.bincount(of[at], minlength=len(queries))
                for q in np.flatnonzero(100 * both >= PERCENT * (size + len(own) - both)).tolist():
                    # a link between components that this task has joined already says nothing more
                    x, y = root(queries[q][0]), root(r["c"])
                    if x != y:
                        up[x] = y
                        out.append((queries[q][0], r["c"]))
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.binary()), "b": pa.array([y for _, y in out], pa.binary())})

    dealt = asked.union(others).repartition(partitions(spark), *key).sortWithinPartitions(*key, "role")
    out = stored(map_batches(dealt, run, "a binary, b binary").distinct(), "verified")
    discard(spark, members)
    return out


class Join:
    """The join over one table: its classes and what is known of their components so far."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str):
        self.spark: SparkSession = docs.sparkSession
        self.texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        self.counts = self.spark.sparkContext.broadcast(shingle_counts(self.texts))
        self.signed = stored(signatures(self.texts, self.counts), "signatures")
        some = self.signed.where("n > 0").groupBy("cls")
        self.classes = stored(some.agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("tokens").alias("tokens")), "classes")
        self.total = self.classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        self.found = components(self.spark.createDataFrame([], "a binary, b binary"))

    def sets_of(self, wanted: DataFrame) -> DataFrame:
        wanted = stored(self.classes.select("cls", "doc_id").join(wanted, "cls", "left_semi"), "wanted")
        out = stored(shingle_sets(self.texts, wanted, wanted.count() <= FEW), "sets")
        discard(self.spark, wanted)
        return out

    def link(self, pairs: DataFrame) -> bool:
        """Verify pairs and extend the components; whether there was any pair."""
        pairs = stored(pairs, "pairs")
        some = not pairs.isEmpty()
        if some:
            sets = self.sets_of(pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct())
            self.join(stored(verified(pairs, sets), "verified"))
            discard(self.spark, sets)
        discard(self.spark, pairs)
        return some

    def join(self, links: DataFrame) -> None:
        before, self.found = self.found, extended(self.found, links)
        discard(self.spark, links, before)

    def listed(self, post: DataFrame, name: str) -> DataFrame:
        """Rows of shingles that two classes or more have, with the size of their list."""
        sizes = post.groupBy("t").agg(F.count("*").alias("size")).where("size > 1")
        return stored(post.join(sizes, "t"), name)

    def long_lists(self, rows: DataFrame) -> DataFrame:
        """Rows of long lists that have members of different components, with these."""
        rows = with_component(rows.where(F.col("size") > SMALL), self.found)
        mixed = rows.groupBy("t").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("t")
        return rows.join(mixed, "t", "left_semi")

    def grouped(self, rows: DataFrame) -> DataFrame:
        """Rows of long lists still mixed, stored, after their members were compared with some of them, if
        that is worth it."""
        mixed = stored(self.long_lists(rows), "long-lists")
        cost = self.cost(mixed)
        for k in range(STARS):
            if cost <= READS * self.total:
                break
            self.link(star(mixed, k))
            before, mixed = mixed, stored(self.long_lists(rows), "long-lists")
            discard(self.spark, before)
            last, cost = cost, self.cost(mixed)
            if cost > LEFT * last:
                break
        return mixed

    def cost(self, mixed: DataFrame) -> int:
        """At most so many shingles are compared when all members of mixed lists are, in blocks."""
        size = mixed.select("cls", "n").distinct().agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        return size[0] * size[1]

    def moved(self, mixed: DataFrame, last: DataFrame | None) -> DataFrame:
        """(cls, n, last, tokens): classes with frequent shingles in their prefix, with another one."""
        met = mixed.join(frequent(mixed), "t", "left_semi").groupBy("cls").agg(F.collect_set("t").alias("met"))
        if last is None:
            met = met.withColumn("last", F.array().cast("array<bigint>"))
        else:
            met = met.join(last.select("cls", "last"), "cls", "left").withColumn("last", F.coalesce("last", F.array().cast("array<bigint>")))
        met = met.where(F.size(F.array_except("met", "last")) > 0).select("cls", F.array_union("last", "met").alias("last"))
        counts = self.counts

        def again(own: np.ndarray, r: dict) -> dict:
            tokens = prefix(own, counts.value, np.array(r["last"], np.int64).view(np.uint64))
            return {"cls": r["cls"], "n": len(own), "last": r["last"], "tokens": tokens.view(np.int64).tolist()}

        wanted = stored(self.classes.select("cls", "doc_id").join(met, "cls"), "wanted")
        out = stored(of_classes(self.texts, wanted, again, "cls binary, n long, last array<long>, tokens array<long>", "last"), "prefixes")
        discard(self.spark, wanted)
        return out

    def lists(self) -> tuple[DataFrame, DataFrame]:
        """All rows of shared prefix shingles, and those of long lists that are still mixed."""
        post = postings(self.classes)
        rows = self.listed(post, "lists")
        mixed = self.grouped(rows)
        moved, last = None, None
        for _ in range(ROUNDS):
            cost = self.cost(mixed)
            if cost <= READS * self.total or (last is not None and cost > LEFT * last):
                break
            last = cost
            more = self.moved(mixed, moved)
            if more.isEmpty():
                discard(self.spark, more)
                break
            if moved is not None:
                more = stored(more.unionByName(moved.join(more.select("cls"), "cls", "left_anti")), "prefixes")
            moved = more
            # only lists that a new prefix reaches are made again
            stay = post.join(moved.select("cls"), "cls", "left_anti")
            new = postings(moved)
            touched = new.select("t").distinct()
            again = self.listed(new.union(stay.join(touched, "t", "left_semi")), "lists")
            self.grouped(again)
            others = rows.drop("size").join(moved.select("cls"), "cls", "left_anti").join(touched, "t", "left_anti")
            rows = self.listed(others.unionByName(again.drop("size")), "lists")
            mixed = stored(self.long_lists(rows), "long-lists")
        return rows, mixed

    def run(self) -> DataFrame:
        """One row a document: doc_id, n (set size), component_id."""
        rows, mixed = self.lists()
        pairs = candidates(rows)
        named = lambda x: self.found.select(F.col("node").alias(x), F.col("component").alias(f"{x}_of"))
        pairs = pairs.join(named("a"), "a", "left").join(named("b"), "b", "left")
        self.link(pairs.where(F.coalesce("a_of", "a") != F.coalesce("b_of", "b")).select("a", "b"))
        rest = stored(self.long_lists(mixed.select("t", "cls", "n", "size")), "rest")
        if not rest.isEmpty():
            sets = self.sets_of(rest.select("cls").distinct())
            self.join(block_links(rest, sets))
            discard(self.spark, sets)
        named = self.classes.select("cls", "doc_id").join(self.found, F.col("cls") == F.col("node"), "left").select("cls", "doc_id", F.coalesce("component", "cls").alias("c"))
        least = named.groupBy("c").agg(F.min("doc_id").alias("component_id"))
        named = named.join(least, "c").select("cls", "component_id")
        out = self.signed.select("doc_id", "n", F.when(F.col("n") > 0, F.col("cls")).alias("k")).join(named, F.col("k") == F.col("cls"), "left")
        out = stored(out.select("doc_id", "n", F.coalesce("component_id", "doc_id").alias("component_id")), "groups")
        discard(self.spark, self.signed, self.classes, rows, mixed, rest)
        self.counts.unpersist()
        return out


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id."""
    return Join(docs, id_col, text_col).run().select("doc_id", F.col("n").alias("n_shingles"), "component_id")
