"""Mixing sources to target weights, with DataFrame functions only.

The words of each source are packed one after another into blocks of a fixed length. Each source
owes the mix a whole number of block slots; the slots of all sources are dealt over output shards of
one size by a pseudorandom permutation, so that a shard's counts of the sources are a multinomial
draw with the sources' sums given. A source's slots are mapped through a pseudorandom permutation of
its block indices (a new one for each pass over the source), and joined to the blocks by index.

A block is taken at most ceil(slots / blocks) times, so no document is taken more often than
its source's target allows. Draws and permutations are hashes of a seed: reruns agree.

Edge cases: null text has no words and is taken 0 times; a null source is a source, the last;
repeated rows are documents of their own; an empty table gives an empty result; a source without
words has target 0; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, WORD, ordered_parts, partitions, stored, unused

#: The weights of the sources in order, repeating; the share of all words that the
#: mix takes; how often a source may be repeated.
WEIGHTS, SHARE, REPEATS = (5, 2, 1), 1.5, 2
#: Words in a block, and slots in an output shard.
BLOCK, SHARD_SLOTS = 128, 4096
#: Rounds of the permutation.
ROUNDS = 24


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: float = REPEATS) -> DataFrame:
    """Targets of (source, source_size): sid, weight and target are added.

    Sharing by weight, stopping at ``repeats`` times the size and resharing the excess ends where
    every target is min(repeats * size, level * weight). The level follows from the sources in
    order of repeats * size / weight: those at the front stop, the rest share what is left. This
    is one ordered pass over one row a source.
    """
    order = W.orderBy(F.col("source").isNull(), "source")
    every = W.partitionBy()
    t = sizes.withColumn("sid", F.row_number().over(order).cast("long"))
    t = t.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    t = t.withColumn("most", F.lit(repeats) * F.col("source_size")).withColumn("total", F.lit(share) * F.sum("source_size").over(every))
    by = W.orderBy(F.col("most") / F.col("weight"), "sid")
    before, rest = by.rowsBetween(W.unboundedPreceding, -1), by.rowsBetween(W.currentRow, W.unboundedFollowing)
    t = t.withColumn("level", (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("weight").over(rest))
    t = t.withColumn("stops", F.col("most") <= F.col("weight") * F.col("level"))
    t = t.withColumn("level", F.min(F.when(~F.col("stops"), F.struct(F.col("most") / F.col("weight"), "sid", "level"))).over(every)["level"])
    target = F.when(F.col("stops"), F.col("most")).otherwise(F.col("weight") * F.col("level"))
    return t.select("source", "source_size", "sid", "weight", target.cast("double").alias("target"))


def permuted(index: Column, n: Column, *key: Column, rounds: int = ROUNDS) -> Column:
    """A pseudorandom permutation of 0..n-1: swap-or-not rounds keyed by ``key``."""

    def step(x: Column, r: Column) -> Column:
        other = F.pmod(F.xxhash64(*key, r) - x, n)
        swap = F.pmod(F.xxhash64(*key, r, F.greatest(x, other)), F.lit(2)) == 1
        return F.when(swap, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), index, step)


def placed(docs: DataFrame, block: int = BLOCK, **shares) -> tuple[DataFrame, DataFrame]:
    """Documents with their place in their source, and the table of sources; both stored.

    All documents are ordered by source and a hash, in parts of even size; places are the running
    words of a part and the words of the parts before it, less those of the sources before. No
    source, however large, is ordered or summed in one task.
    """
    sized = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")), "mix-sizes")
    sources = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), **shares)
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    slots = F.when(F.col("source_size") > 0, F.round(F.col("target") * blocks / F.col("source_size"))).otherwise(0).cast("long")
    earlier = W.orderBy("sid").rowsBetween(W.unboundedPreceding, -1)
    sources = sources.select("*", blocks.alias("blocks"), slots.alias("slots"))
    sources = stored(sources.select("*", *[F.coalesce(F.sum(x).over(earlier), F.lit(0)).alias(f"{x}_before") for x in ("source_size", "slots")]), "mix-sources")
    rows = sized.join(sources.select(F.col("source").alias("s"), "sid", "source_size", "target", "source_size_before"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = ordered_parts(rows, ["sid", F.xxhash64("doc_id", "h"), "doc_id", "h"], "mix-order")
    before = W.partitionBy("part").orderBy("g").rowsBetween(W.unboundedPreceding, -1)
    totals = rows.groupBy("part").agg(F.sum("size").alias("n"))
    totals = totals.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    rows = rows.withColumn("local", F.coalesce(F.sum("size").over(before), F.lit(0))).join(F.broadcast(totals), "part")
    start = F.col("local") + F.col("base") - F.col("source_size_before")
    rows = rows.select("g", "doc_id", "h", "source", "size", "sid", "source_size", "target", start.alias("start"))
    return rows, sources


def drawn_slots(sources: DataFrame, seed: int = 0, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """Slots of the output: shard, sid, pass (0 for the first time over a source), block.

    A source's slots are its numbers from 0; all slots together are dealt over shards of one size by
    a permutation of their numbers. So the counts of the sources in a shard are a multinomial draw
    under the condition that each source gets its slots and each shard is full.
    """
    each = F.lit(4096).cast("long")
    every = sources.agg(F.sum("slots")).first()[0] or 0
    s = sources.where("slots > 0").select("sid", "slots", "blocks", F.col("slots_before").alias("before"))

    def split(t: DataFrame, left: Column, name: str) -> DataFrame:
        return t.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.least(each, left) - 1)).alias(name))

    # in three steps, so that no list of a source's slots is ever built
    t = s.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("slots") / (each * each)) - 1)).alias("x"))
    t = split(t, F.ceil((F.col("slots") - F.col("x") * each * each) / each), "y").withColumn("y", F.col("x") * each + F.col("y"))
    t = t.repartition(partitions(sources.sparkSession), "sid", "y")
    t = split(t, F.col("slots") - F.col("y") * each, "z").withColumn("slot", F.col("y") * each + F.col("z"))
    turn = (F.col("slot") / F.col("blocks")).cast("long")
    shard = (permuted(F.col("before") + F.col("slot"), F.lit(every), F.lit(seed), F.lit("shard")) / shard_slots).cast("long")
    t = t.select("sid", "blocks", "slot", turn.alias("pass"), shard.alias("shard"))
    return t.select("shard", "sid", "pass", permuted(F.pmod("slot", "blocks"), F.col("blocks"), F.lit(seed), F.col("sid"), F.col("pass")).alias("block"))


def blocks_of(rows: DataFrame, block: int) -> DataFrame:
    """One row for each block that a document reaches into: block, lo and hi (words of the document)."""
    end = F.col("start") + F.col("size")
    reach = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block)))
    t = rows.select("*", F.explode_outer(reach).alias("block"))
    return t.select("*", (F.greatest("start", F.col("block") * block) - F.col("start")).alias("lo"), (F.least(end, (F.col("block") + 1) * block) - F.col("start")).alias("hi"))


def mixed_counts(docs: DataFrame, block: int = BLOCK, seed: int = 0, **shares) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words of it in the mix), source."""
    rows, sources = placed(docs, block, **shares)
    times = drawn_slots(sources, seed).groupBy("sid", "block").agg(F.count("*").alias("times"))
    got = blocks_of(rows, block).join(times.hint("merge"), ["sid", "block"], "left")
    words = F.coalesce((F.col("hi") - F.col("lo")) * F.col("times"), F.lit(0))
    out = got.groupBy("g", "doc_id", "size", "source_size", "target", "source").agg(F.sum(words).alias("taken"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source")


def mixed_documents(docs: DataFrame, block: int = BLOCK, seed: int = 0, **shares) -> DataFrame:
    """The mix as documents, with the columns of ``docs``.

    Each row is one longest run of neighbouring taken blocks of one document in one pass over its
    source; its text is that slice of the document's text and n_chars its length. A document taken
    whole keeps its whole text; one taken twice is there twice; one not taken is not there.
    Rows that repeat both id and text share one text.
    """
    rows, sources = placed(docs, block, **shares)
    taken = blocks_of(rows.where("size > 0"), block).join(drawn_slots(sources, seed).select("sid", "block", "pass").hint("merge"), ["sid", "block"])
    spans = taken.groupBy("g", "doc_id", "h", "size", "pass").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("spans"))
    # a run begins where the block before it was not taken, and reaches to the end of its last one
    begins = F.filter(F.sequence(F.lit(0), F.size("spans") - 1), lambda i: (i == 0) | (F.get("spans", i)["lo"] != F.get("spans", i - 1)["hi"]))
    runs = spans.withColumn("begins", begins)
    runs = runs.withColumn("runs", F.transform("begins", lambda i, k: F.struct(F.get("spans", i)["lo"].alias("lo"), F.get("spans", F.coalesce(F.get("begins", k + 1), F.size("spans")) - 1)["hi"].alias("hi"))))

    no_id, id_, h, size, run = names = unused(docs, "_no_id", "_id", "_h", "_size", "_run")
    keyed = lambda t, x: t.select("*", F.col("doc_id").isNull().alias(no_id), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias(id_), x.alias(h))
    runs = keyed(runs.select("doc_id", F.col("h").alias("text"), F.col("size").alias(size), F.explode("runs").alias(run)), F.col("text")).select(names)
    # reduced and joined on the same columns: one exchange of the texts
    texts = keyed(docs, F.xxhash64("text")).dropDuplicates(names[:3])
    both = texts.join(runs.hint("merge"), names[:3])
    words = F.regexp_extract_all("text", F.lit(f"(?:^{SPACE}+)?{WORD}{SPACE}*"), F.lit(0))
    part = F.array_join(F.slice(words, (F.col(f"{run}.lo") + 1).cast("int"), (F.col(f"{run}.hi") - F.col(f"{run}.lo")).cast("int")), "")
    whole = (F.col(f"{run}.lo") == 0) & (F.col(f"{run}.hi") == F.col(size))
    both = both.withColumn("text", F.when(whole, F.col("text")).otherwise(part))
    if "n_chars" in docs.columns:
        both = both.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return both.select(docs.columns)
