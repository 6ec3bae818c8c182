"""Joins of references, positions, bindings and change sets with symbols."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import dealt, kept, parts_of

#: Rows of one key that a task holds when pairs of namesakes are made: ids; of targets an eighth.
BLOCK = 4096
#: Ids that follow each other for one target after the other, and pairs of one part.
LIST, PAIRS = 256, 1 << 23


def narrowest(probes: DataFrame, spans: DataFrame, probe_key: str = "probe_id", cell: int = 1024) -> DataFrame:
    """For each probe (probe_id, file, offset) the narrowest span that covers it, first by start and id.

    Offsets are cut into cells; a span is joined in each cell it reaches, so that a file with very
    many symbols is many keys. Spans far longer than a cell are joined in larger cells. The choice
    is an aggregate, within a cell first, so no probe's candidates are sorted in one task. Parts are by
    the number of probes and spans.
    """
    s = spans.select(F.col("file").alias("_file"), F.col("start_pos").alias("_start"), F.col("end_pos").alias("_end"), F.col("id").alias("_id")).where("_end > _start")
    # sizes of cells grow by 64, so that a span reaches at most 65 of them
    sizes = [cell * 64**k for k in range(6)]
    size = F.lit(sizes[-1])
    for x in sizes[-2::-1]:
        size = F.when(F.col("_end") - F.col("_start") <= 64 * x, F.lit(x)).otherwise(size)
    s = s.withColumn("_size", size.cast("long"))
    s = s.select("*", F.explode(F.sequence(F.floor(F.col("_start") / F.col("_size")), F.floor((F.col("_end") - 1) / F.col("_size")))).alias("_cell"))
    used = {r[0]: r[1] for r in s.groupBy("_size").agg(F.count("*")).collect()}
    n = probes.count() * len(used) + sum(used.values())
    p = probes.select(probe_key, F.col("file").alias("_in"), F.col("offset").alias("_at"), F.explode(F.array(*map(F.lit, used)).cast("array<bigint>")).alias("_of"))
    p = p.withColumn("_place", F.floor(F.col("_at") / F.col("_of")))
    p, s = dealt(p, n, "_in", "_of", "_place"), dealt(s, n, "_file", "_size", "_cell")
    hit = p.join(s, (p._in == s._file) & (p._of == s._size) & (p._place == s._cell)).where("_start <= _at and _at < _end")
    least = F.min(F.struct((F.col("_end") - F.col("_start")).alias("width"), F.col("_start").alias("start"), F.col("_id").alias("id"))).alias("b")
    hit = hit.groupBy("_in", "_of", "_place", probe_key).agg(least).select(probe_key, "b")
    return dealt(hit, n, probe_key).groupBy(probe_key).agg(F.min("b").alias("b")).select(probe_key, "b.id", "b.width")


def definitions(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    s = symbols.select(F.col("id").alias("symbol_id"), F.col("name").alias("def_name"), F.col("file").alias("def_file"), F.col("start_pos").alias("def_start"))
    return refs.join(s, "symbol_id", "left")


def outside_definition(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """References that do not lie inside the definition they refer to."""
    s = symbols.select(F.col("id").alias("symbol_id"), F.col("file").alias("_f"), F.col("start_pos").alias("_s"), F.col("end_pos").alias("_e"))
    inside = (F.col("file") == F.col("_f")) & (F.col("start_pos") >= F.col("_s")) & (F.col("end_pos") <= F.col("_e"))
    return refs.join(s, "symbol_id", "left").where(~F.coalesce(inside, F.lit(False))).drop("_f", "_s", "_e")


def first_of(rows: DataFrame, keys: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """The first row of each key by ``order``, as an aggregate."""
    pick = F.min(F.struct(*[o.alias(f"_o{k}") for k, o in enumerate(order)], *columns)).alias("_p")
    return rows.groupBy(*keys).agg(pick).select(*keys, *[f"_p.{c}" for c in columns])


def resolved(rows: DataFrame, row_key: str, candidates: Column, table: DataFrame, table_key: str, value: str, fallback: str) -> DataFrame:
    """For each row the value of the first of its candidate keys that the table has, else its fallback.

    ``candidates`` is an array in order of preference; the table has one value a key.
    """
    t = table.select(F.col(table_key).alias("_k"), F.col(value).alias("_v"))
    c = rows.select(row_key, fallback, F.posexplode_outer(candidates).alias("_rank", "_k"))
    hit = c.join(t, "_k", "left").groupBy(row_key, fallback).agg(F.min(F.when(F.col("_v").isNotNull(), F.struct("_rank", "_v")))["_v"].alias("_v"))
    return hit.select(row_key, F.coalesce("_v", fallback).alias("resolved"))


def _pairs(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(target_id, id) of ``left`` (target_id) and ``right`` (id) with equal ``keys``, of which many
    rows of both sides may have one.

    Rows of a key are cut into blocks of about ``BLOCK`` ids, and an eighth as many targets, by hashes;
    a pair of blocks is a key of its own. So one name's pairs are made by many tasks, in parts by the
    number of pairs; each holds at most a block, and the pairs themselves are neither exchanged nor
    stored. A block's ids are lists of ``LIST``, and targets take one list in turn, so that columns
    of the result repeat within a page of what is written and take a fraction of a byte a row; a part
    has few blocks, so that its ids stay in one dictionary.
    """
    sizes = lambda rows, name: rows.groupBy(*keys).agg(F.count("*").alias(name))
    cut = kept(sizes(left, "_lefts").join(sizes(right, "_rights"), keys), "blocks")
    n = parts_of(left.sparkSession, int(cut.agg(F.sum(F.col("_lefts").cast("double") * F.col("_rights"))).first()[0] or 0), PAIRS)
    cut = cut.select(*keys, F.ceil(F.col("_lefts") / (BLOCK / 8)).cast("int").alias("_lefts"), F.ceil(F.col("_rights") / BLOCK).cast("int").alias("_rights"))
    own = lambda column, of: F.pmod(F.xxhash64(column), of).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    x = left.join(cut, keys).select(*keys, "target_id", own("target_id", F.col("_lefts")).alias("_x"), every("_rights").alias("_y"))
    y = right.join(cut, keys).groupBy(*keys, "_lefts", own("id", F.col("_rights")).alias("_y"))
    # in structs, as a list leaves nulls out
    y = y.agg(F.transform(F.array_sort(F.collect_list(F.struct("id"))), lambda r: r["id"]).alias("_ids"))
    lists = F.transform(F.sequence(F.lit(0), F.floor((F.size("_ids") - 1) / LIST).cast("int")), lambda k: F.slice("_ids", k * LIST + 1, LIST))
    y = y.select(*keys, "_lefts", "_y", F.explode(lists).alias("_ids")).select(*keys, every("_lefts").alias("_x"), "_y", "_ids")
    on = [*keys, "_x", "_y"]
    return y.repartition(n, *on).join(x.repartition(n, *on).hint("merge"), on).select("target_id", F.explode("_ids").alias("id"))


def _different_pairs(left: DataFrame, own: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct (target_id, id) with equal ``keys`` and different ids; rows of both sides are distinct.

    An id with one row in ``own`` meets a target once, so only pairs of other ids are made distinct.
    """
    several = own.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    met = lambda rows: _pairs(left.select("target_id", *keys), rows.select("id", *keys), keys).where("id <> target_id")
    return met(own.join(several, "id", "left_anti")).union(met(own.join(several, "id", "left_semi")).distinct())


def implementations(edges: DataFrame, symbols: DataFrame, target: DataFrame, deps: DataFrame) -> DataFrame:
    """Symbols that lead to the targets by an edge; for targets without any, symbols of the same
    name in dependent files or their own; for those still without, of the same name anywhere.
    ``target`` has id, name, file. The result has target_id, id and the tier.

    A tier is joined only for the targets that the tiers before it left. Whether a target has
    namesakes is told by the least and greatest id of a name in a file, so that no pairs are stored.
    """
    t = target.select(F.col("id").alias("target_id"), "name", F.col("file").alias("_file")).distinct()
    own = symbols.select("id", "name", "file").distinct()
    one = kept(t.join(edges, F.col("target_id") == F.col("dst")).select("target_id", F.col("src").alias("id")).where("id <> target_id").distinct().join(symbols.select("id"), "id", "left_semi"), "tier")
    left = kept(t.join(one, "target_id", "left_anti"), "left")
    groups = own.groupBy("name", "file").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    names = left.select("name", "_file").distinct()
    places = names.join(deps.select(F.col("to_file").alias("_file"), F.col("from_file").alias("file")).distinct(), "_file").select("name", "_file", "file")
    places = places.union(names.select("name", "_file", F.col("_file").alias("file"))).distinct().join(groups, ["name", "file"])
    near = left.join(places, ["name", "_file"]).where("low <> target_id or high <> target_id")
    near = kept(near.select("target_id", "name", "file").distinct(), "near")
    two = _different_pairs(near, own, ["name", "file"])
    left = left.select("target_id", "name").distinct().join(near, "target_id", "left_anti")
    three = _different_pairs(left, own.select("id", "name").distinct(), ["name"])
    tier = lambda rows, n: rows.select("target_id", "id", F.lit(n).alias("tier"))
    return tier(one, 1).union(tier(two, 2)).union(tier(three, 3))


def implementations_or_namesakes(edges: DataFrame, symbols: DataFrame, target: DataFrame) -> DataFrame:
    """(target_id, id, tier): sources of edges to each target; for targets without any, all symbols
    of its name, itself included, if there are two or more."""
    t = target.select(F.col("id").alias("target_id"), "name")
    one = kept(t.join(edges, F.col("target_id") == F.col("dst")).select("target_id", F.col("src").alias("id")).distinct().join(symbols.select("id"), "id", "left_semi"), "tier")
    several = symbols.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name")
    left = t.join(one, "target_id", "left_anti").join(several, "name", "left_semi")
    two = _pairs(left, symbols.select("id", "name"), ["name"])
    return one.select("target_id", "id", F.lit(1).alias("tier")).union(two.select("target_id", "id", F.lit(2).alias("tier")))


def name_positions(sources: DataFrame, name: str, key: str = "file", content: str = "content") -> DataFrame:
    """Places of a word in texts, with ASCII word boundaries: (file, start_pos) in characters."""
    parts = F.split(content, "(?<![A-Za-z0-9_])" + re.escape(name) + "(?![A-Za-z0-9_])", -1)
    t = sources.where(F.col(content).contains(name)).select(key, F.posexplode(parts).alias("i", "part"))
    before = F.sum(F.length("part") + len(name)).over(W.partitionBy(key).orderBy("i"))
    t = t.withColumn("start_pos", (before - len(name)).cast("long"))
    last = F.max("i").over(W.partitionBy(key))
    return t.withColumn("_last", last).where("i < _last").select(key, "start_pos")
