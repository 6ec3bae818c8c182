"""Quotation linking: conversations in reply order, without the quotes.

Lines that begin with ``>`` marks are quotes, nested as deep as the marks. A message's quoted
passages (neighbouring lines of one depth) are normalised (letters and digits of any script,
lower-cased) and hashed; so are all own passages of all messages, line by line and whole. A quote
is linked to the earliest message of its conversation that has the passage as its own words, and
each message replies to the message of its first linked quote of depth one, else to the message
before it. Messages come out in reply order: a reply after what it answers, answers to one
message by turn.

All messages are numbered once over the whole table, in parts of even size, so that no
conversation, however long, is one task's to sort. A passage that very many messages have is one
row after grouping by conversation and hash, so links grow with the quotes, not with pairs. Reply
order is the ranking of one list: the tour that goes down and up the reply trees. Its rounds are
the logarithm of the longest tour, and each row keeps its size.

Edge cases: null text is empty; a message that is nothing but quotes has empty own text; a quote
without a letter or digit, or of unknown origin, gets no link; rows that repeat conversation and
turn are messages of their own, ordered by role and text; null conversations are one; a null turn
comes first; an empty table gives an empty result; columns other than conv_id, turn, role and text
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import carried, discard, ordered_parts, stored

#: Fixed value: marks of a quoted line.
MARKS = r"^[ \t]*((?:>[ \t]?)+)"


def _hash(text: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.when(plain != "", F.xxhash64(plain))


def parsed(messages: DataFrame) -> DataFrame:
    """part, g (number over all messages), first (g of the conversation's first message), conv_id,
    turn, role, own (text without quotes) and passages (depth, text): quoted ones with their depth,
    the message's own with 0; stored."""
    t = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    lines = F.transform(F.split("text", "\n"), lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 1), r"[ \t]", "")).alias("depth"), F.regexp_replace(x, MARKS, "").alias("line")))
    keys = [F.col(x).asc_nulls_first() for x in ("conv_id", "turn", "role", "text")]
    t = ordered_parts(t, keys, "messages")
    # the first message of each conversation: another one stands before it, in its part or the last
    ends = t.groupBy("part").agg(F.max(F.struct("g", "conv_id"))["conv_id"].alias("end"))
    ends = ends.select(F.col("part").alias("_part"), F.lag(F.struct("end")).over(W.orderBy("part")).alias("end"))
    t = t.join(F.broadcast(ends), F.col("part") == F.col("_part")).drop("_part")
    before = F.coalesce(F.lag(F.struct(F.col("conv_id").alias("end"))).over(W.partitionBy("part").orderBy("g")), F.col("end"))
    t = t.withColumn("before", before)
    starts = F.col("before").isNull() | ~F.col("before.end").eqNullSafe(F.col("conv_id"))
    t = carried(t, F.when(starts, F.col("g")), "first").withColumn("lines", lines)
    t = t.select("part", "g", "first", "conv_id", "turn", "role", F.col("lines.depth").alias("depths"), F.col("lines.line").alias("lines"))
    begins = F.filter(F.sequence(F.lit(1), F.size("depths")), lambda i: (i == 1) | (F.element_at("depths", i) != F.get("depths", i - 2)))
    t = t.withColumn("begins", begins)
    passage = lambda at, k: F.struct(F.element_at("depths", at).alias("depth"), F.array_join(F.slice("lines", at, F.coalesce(F.get("begins", k + 1), F.size("lines") + 1) - at), "\n").alias("text"))
    own = F.array_join(F.filter("lines", lambda x, i: F.get("depths", i) == 0), "\n")
    return stored(t.select("part", "g", "first", "conv_id", "turn", "role", F.trim(own).alias("own"), F.transform("begins", passage).alias("passages")), "parsed")


def linked(messages: DataFrame) -> DataFrame:
    """One row a message: conv_id, turn, role, text (without quotes), n_quotes, n_linked,
    reply_to (turn), depth (replies above it) and place (in reply order, from 0)."""
    t = parsed(messages)
    quotes = t.select("first", "g", F.posexplode(F.filter("passages", lambda p: p["depth"] > 0)).alias("i", "q"))
    # a passage may be quoted whole or in part: its lines are looked up too
    parts = quotes.select("first", "g", "i", "q.depth", F.posexplode(F.concat(F.array("q.text"), F.split("q.text", "\n"))).alias("j", "x"))
    parts = parts.select("*", _hash(F.col("x")).alias("k")).where("k is not null")
    own = t.select("first", "g", F.explode(F.filter("passages", lambda p: p["depth"] == 0)).alias("p"))
    lines = own.select("first", "g", F.explode(F.array_append(F.split("p.text", "\n"), F.col("p.text"))).alias("x"))
    origin = lines.union(t.select("first", "g", F.col("own").alias("x"))).select("first", "g", _hash(F.col("x")).alias("k")).where("k is not null")
    # only passages that some message of the conversation quotes
    origin = origin.join(parts.select("first", "k").distinct(), ["first", "k"], "left_semi").groupBy("first", "k").agg(F.min("g").alias("origin"))
    hits = parts.join(origin, ["first", "k"]).where("origin < g")
    best = hits.groupBy("g", "i", "depth").agg(F.min(F.struct("j", "origin"))["origin"].alias("origin"))
    told = best.groupBy("g").agg(F.count("*").alias("n_linked"), F.min(F.when(F.col("depth") == 1, F.struct("i", "origin")))["origin"].alias("answers"))
    out = t.join(told, "g", "left")
    n_quotes = F.size(F.filter("passages", lambda p: p["depth"] > 0))
    parent = F.coalesce("answers", F.when(F.col("g") > F.col("first"), F.col("g") - 1))
    out = out.select("part", "g", "first", "conv_id", "turn", "role", F.col("own").alias("text"), n_quotes.cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), parent.alias("parent"))
    out = stored(out, "replies")
    discard(messages.sparkSession, t)
    return ordered(out)


def _runs(t: DataFrame) -> DataFrame:
    """Runs as a tree: head, first, parent, above (head of the parent's run), n (messages), and
    their number among all runs by conversation, run above, place in it; stored.

    A run's members come before its side runs, and side runs at later members before those at
    earlier ones: a message's reply is all told before the answers beside it.
    """
    runs = t.groupBy("head").agg(F.first("first").alias("first"), F.min(F.when(F.col("g") == F.col("head"), F.struct("parent")))["parent"].alias("parent"), F.count("*").alias("n"))
    runs = runs.join(t.select(F.col("g").alias("parent"), F.col("head").alias("above")), "parent", "left")
    runs = runs.withColumn("above", F.coalesce("above", F.lit(-1)))
    return ordered_parts(runs.select("head", "first", "parent", "above", "n"), ["first", "above", F.col("parent").desc_nulls_last(), "head"], "runs")


def _tour(runs: DataFrame) -> DataFrame:
    """(event, next, n, deeper): the tour of the trees, down 2 * head and up 2 * head + 1, with the
    messages told and the levels won at each event."""
    after = runs.select((F.col("g") - 1).alias("g"), F.col("head").alias("sibling"), F.col("first").alias("of"), F.col("above").alias("beside"))
    t = runs.join(after, "g", "left").withColumn("sibling", F.when((F.col("of") == F.col("first")) & (F.col("beside") == F.col("above")), F.col("sibling"))).drop("of", "beside")
    child = runs.where("above >= 0").groupBy(F.col("above").alias("head")).agg(F.min(F.struct("g", F.col("head").alias("child")))["child"].alias("child"))
    t = t.join(child, "head", "left")
    levels = F.when(F.col("above") >= 0, F.col("parent") - F.col("above") + 1).otherwise(0)
    down = F.struct((2 * F.col("head")).alias("event"), F.coalesce(2 * F.col("child"), 2 * F.col("head") + 1).alias("next"), F.col("n").alias("n"), levels.alias("deeper"))
    up = F.struct((2 * F.col("head") + 1).alias("event"), F.coalesce(2 * F.col("sibling"), F.when(F.col("above") >= 0, 2 * F.col("above") + 1)).alias("next"), F.lit(0).cast("long").alias("n"), (-levels).alias("deeper"))
    return t.select(F.explode(F.array(down, up)).alias("x")).select("x.*")


def ordered(t: DataFrame) -> DataFrame:
    """Depth and reply order from each message's parent.

    ``t`` has (part, g), the order of all messages, first, the conversation's first g, and parent, a
    g. A message that answers the one before it continues that one's run; the tour of the tree of
    runs is ranked by pointer doubling.
    """
    spark = t.sparkSession
    new = F.col("parent").isNull() | (F.col("parent") != F.col("g") - 1)
    t = stored(carried(t, F.when(new, F.col("g")), "head"), "headed")
    runs = _runs(t)
    # a conversation of one run has its order already
    several = runs.groupBy("first").agg(F.count("*").alias("n")).where("n > 1").select("first")
    some = stored(runs.join(several, "first", "left_semi"), "several")
    now = stored(_tour(some), "tour")
    while not now.where("next is not null").isEmpty():
        on = now.select(F.col("event").alias("next"), F.col("next").alias("further"), F.col("n").alias("m"), F.col("deeper").alias("more"))
        old, now = now, stored(now.join(on, "next", "left").select("event", F.col("further").alias("next"), (F.col("n") + F.coalesce("m", F.lit(0))).alias("n"), (F.col("deeper") + F.coalesce("more", F.lit(0))).alias("deeper")), "tour")
        discard(spark, old)
    # what is told from an event to the end of its list gives what was told before it
    total = some.groupBy("first").agg(F.sum("n").alias("total"))
    levels = F.when(F.col("above") >= 0, F.col("parent") - F.col("above") + 1).otherwise(0)
    told = some.select("head", "first", levels.alias("levels")).join(total, "first").join(now.select((F.col("event") / 2).cast("long").alias("head"), F.col("n").alias("left"), "deeper").where(F.col("event") % 2 == 0), "head")
    told = told.select("head", (F.col("total") - F.col("left")).alias("told"), (F.col("levels") - F.col("deeper")).alias("level"))
    turn = t.select(F.col("g").alias("parent"), F.col("turn").alias("reply_to"))
    out = t.join(told, "head", "left").join(turn, "parent", "left")
    step = F.col("g") - F.col("head")
    out = stored(out.select("conv_id", "turn", "role", "text", "n_quotes", "n_linked", "reply_to", (F.coalesce("level", F.lit(0)) + step).cast("long").alias("depth"), (F.coalesce("told", F.lit(0)) + step).cast("long").alias("place")), "ordered")
    discard(spark, t, runs, some, now)
    return out
