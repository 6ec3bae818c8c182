"""Strong components and build order of dependency tables, in few rounds however long the chains are.

Edge cases: a file that depends on itself is a component of one, marked as a cycle; dependencies of files
that are not listed do not count; nulls are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import dealt, kept


def joined(left: DataFrame, right: DataFrame, key: str, n: int, how: str = "inner") -> DataFrame:
    """A join of tables that grow, with parts for ``n`` rows. It is never by a broadcast, which would send a
    table to the driver in each of very many rounds."""
    return dealt(left, n, key).join(dealt(right, n, key).hint("merge"), key, how)


def least_reachable(links: DataFrame, nodes: DataFrame, salt: int = 0) -> DataFrame:
    """(node, least): the node of the smallest label that each node reaches by links (a, b), itself included.

    A label is a salted hash of the node, so that its order has nothing to do with that of the links. In
    each round a node takes the least of its own, its neighbours' and that of the node it has
    reached so far, so that distances grow by a factor and not by one.
    """
    label = lambda c: F.struct(F.xxhash64(c, F.lit(salt)).alias("h"), F.col(c).alias("id"))
    now, n = kept(nodes.select("node", label("node").alias("l")), "labels"), links.count()
    while True:
        of = now.select(F.col("node").alias("b"), F.col("l").alias("lb"))
        near = dealt(joined(links, of, "b", n).select(F.col("a").alias("node"), "lb"), n, "node").groupBy("node").agg(F.min("lb").alias("near"))
        jump = now.select(F.col("node").alias("at"), F.col("l").alias("far"))
        new = joined(joined(now, near, "node", n, "left").withColumn("at", F.col("l.id")), jump, "at", n, "left")
        new = kept(new.select("node", F.least("l", F.coalesce("near", "l"), F.coalesce("far", "l")).alias("l"), F.col("l").alias("was")), "labels")
        if new.where("l <> was").isEmpty():
            return new.select("node", F.col("l.id").alias("least"))
        now = new.select("node", "l")


def without_ends(links: DataFrame) -> DataFrame:
    """The links of nodes that do not lead to an end by single links: a node without links, one whose
    only link leads to such a node, and so on. Single links are doubled, so that a chain goes at once."""
    n = links.count()
    out = dealt(links, n, "a").groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("to"))
    step = kept(out.where("n = 1").select("a", "to"), "steps")
    # a pointer on a cycle never ends; no other is longer than the number of single links
    for _ in range(step.count().bit_length()):
        next_ = step.select(F.col("a").alias("to"), F.col("to").alias("to2"))
        step = kept(joined(step, next_, "to", n, "left").select("a", F.coalesce("to2", "to").alias("to"), F.col("to2").isNotNull().alias("moved")), "steps")
        if step.where("moved").isEmpty():
            break
        step = step.drop("moved")
    more = out.select(F.col("a").alias("to"))
    ended = joined(step.select("a", "to"), more, "to", n, "left_anti").select("a")
    links = kept(joined(links, ended, "a", n, "left_anti"), "links")
    return kept(joined(links, dealt(links.select(F.col("a").alias("b")), n, "b").distinct(), "b", n, "left_semi").select("a", "b"), "links")


def strong_components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component): the strong component of each node over links (a, b), named by its smallest node.

    Nodes that lead to an end, or from a beginning, by single links are components of their own and go
    first. Of the others, those that reach the same least node and are reached by it among those
    are a component. Other nodes are in one component only if both the least node that they reach and
    the least one that reaches them among these are the same, so all other links go; with new labels
    each round cuts what is left as a random pivot cuts a list.
    """
    left = links.select("a", "b").where("a <> b")
    n = left.count()
    nodes = kept(dealt(nodes.select("node").where("node is not null"), n, "node").distinct(), "nodes")
    named = lambda c: nodes.select(F.col("node").alias(c))
    left = kept(dealt(left, n, "a", "b").distinct(), "links")
    left = kept(joined(left, named("a"), "a", n, "left_semi"), "links")
    left = joined(left, named("b"), "b", n, "left_semi").select("a", "b")
    turned = lambda t: t.select(F.col("b").alias("a"), F.col("a").alias("b"))
    found, salt = None, 0
    while True:
        left = kept(turned(without_ends(kept(turned(without_ends(kept(left, "links"))), "links"))), "links")
        if left.isEmpty():
            break
        salt += 1
        n = left.count()
        open_ = kept(dealt(left.select(F.col("a").alias("node")).union(left.select("b")), 2 * n, "node").distinct(), "open")
        forward = kept(least_reachable(left, open_, salt), "forward")
        of = lambda c, name, t: t.select(F.col("node").alias(c), F.col("least").alias(name))
        same = kept(joined(joined(left, of("a", "la", forward), "a", n), of("b", "lb", forward), "b", n).where("la = lb").select("a", "b"), "same")
        backward = kept(least_reachable(turned(same), open_, salt), "backward")
        done = kept(joined(forward, backward.withColumnRenamed("least", "from"), "node", n).where("least = from").select("node", "least"), "components")
        found = done if found is None else kept(found.union(done), "components")
        gone = done.select(F.col("node").alias("a"))
        left = joined(joined(same, of("a", "la", backward), "a", n), of("b", "lb", backward), "b", n).where("la = lb").select("a", "b")
        left = joined(left, gone, "a", n, "left_anti")
    if found is None:
        return nodes.select("node", F.col("node").alias("component"))
    n = nodes.count()
    names = dealt(found, n, "least").groupBy("least").agg(F.min("node").alias("component"))
    found = joined(found, names, "least", n).select("node", "component")
    return kept(joined(nodes, found, "node", n, "left").select("node", F.coalesce("component", "node").alias("component")), "components")


def longest_paths(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, level): the length of the longest path of links (a, b) from each node; links without cycles.

    Nodes without links have a level. A node with a single link has the level ``max(base, level(b) + w)``;
    such steps are composed by doubling until they end at a node of another kind, which takes the
    place of all nodes on the way in the links that are left. Parallel links become one, so that
    chains of diamonds vanish as chains do. Rounds grow with the depth of what then is left.
    """
    n, m = links.count(), nodes.count()
    open_ = kept(dealt(nodes.select("node", F.lit(0).cast("long").alias("base")), m, "node").distinct(), "open")
    links = kept(dealt(links.select("a", "b", F.lit(1).cast("long").alias("w")), n, "a", "b").distinct(), "links")
    steps, levels = [], None
    while not open_.isEmpty():
        n = max(links.count(), open_.count())
        ends = kept(joined(open_, dealt(links.select(F.col("a").alias("node")), n, "node").distinct(), "node", n, "left_anti").select("node", F.col("base").alias("level")), "levels")
        levels = ends if levels is None else levels.union(ends)
        reached = joined(links, ends.select(F.col("node").alias("b"), "level"), "b", n).select(F.col("a").alias("node"), (F.col("level") + F.col("w")).alias("reached"))
        reached = dealt(reached, n, "node").groupBy("node").agg(F.max("reached").alias("reached"))
        open_ = joined(joined(open_, ends, "node", n, "left_anti"), reached, "node", n, "left").select("node", F.greatest("base", F.coalesce("reached", F.lit(0))).alias("base"))
        open_ = kept(open_, "open")
        links = kept(joined(links, ends.select(F.col("node").alias("b")), "b", n, "left_anti"), "links")
        one = dealt(links, n, "a").groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("to"), F.max("w").alias("w")).where("n = 1")
        step = kept(joined(one, open_.withColumnRenamed("node", "a"), "a", n).select("a", "to", "w", "base"), "steps")
        if step.isEmpty():
            continue
        while True:
            next_ = step.select(F.col("a").alias("to"), F.col("to").alias("to2"), F.col("w").alias("w2"), F.col("base").alias("base2"))
            new = joined(step, next_, "to", n, "left").select("a", F.coalesce("to2", "to").alias("to"), (F.col("w") + F.coalesce("w2", F.lit(0))).alias("w"), F.greatest("base", F.coalesce(F.col("base2") + F.col("w"), "base")).alias("base"), F.col("to2").isNotNull().alias("moved"))
            new = kept(new, "steps")
            step = new.drop("moved")
            if new.where("moved").isEmpty():
                break
        steps.append(step)
        gone = step.select("a")
        open_ = kept(joined(open_, gone.withColumnRenamed("a", "node"), "node", n, "left_anti"), "open")
        links = joined(joined(links, gone, "a", n, "left_anti"), step.select(F.col("a").alias("b"), "to", F.col("w").alias("more"), F.col("base").alias("least")), "b", n, "left")
        links = kept(links.select("a", F.coalesce("to", "b").alias("b"), (F.col("w") + F.coalesce("more", F.lit(0))).alias("w"), (F.col("least") + F.col("w")).alias("least")), "links")
        # what a step brings of its own goes to the node before it
        brought = dealt(links.select(F.col("a").alias("node"), "least"), n, "node").groupBy("node").agg(F.max("least").alias("brought"))
        open_ = kept(joined(open_, brought, "node", n, "left").select("node", F.greatest("base", F.coalesce("brought", "base")).alias("base")), "open")
        links = kept(dealt(links, n, "a", "b").groupBy("a", "b").agg(F.max("w").alias("w")), "links")
    for step in reversed(steps):
        told = joined(step, levels.select(F.col("node").alias("to"), "level"), "to", m).select(F.col("a").alias("node"), F.greatest("base", F.col("level") + F.col("w")).alias("level"))
        levels = kept(levels.union(told), "levels")
    return nodes.select("node", F.lit(0).cast("long").alias("level")).limit(0) if levels is None else levels


def build_order(deps: DataFrame, files: DataFrame) -> DataFrame:
    """(file, component, n_files, in_cycle, level): files after all that they need, by level; files of a
    cycle are one component and share its level, what only lies behind them has its own."""
    links = deps.select(F.col("from_file").alias("a"), F.col("to_file").alias("b"))
    n = links.count()
    nodes = kept(dealt(files.select(F.col("file").alias("node")).where("node is not null"), n, "node").distinct(), "nodes")
    m = nodes.count()
    parts = kept(strong_components(links, nodes), "components")
    of = lambda c: parts.select(F.col("node").alias(c), F.col("component").alias(f"{c}_of"))
    between = kept(joined(dealt(links, n, "a", "b").distinct(), of("a"), "a", n), "between")
    between = joined(between, of("b"), "b", n)
    heads = kept(dealt(parts, m, "component").groupBy("component").agg(F.count("*").alias("n_files")), "sizes")
    levels = longest_paths(kept(between.where("a_of <> b_of").select(F.col("a_of").alias("a"), F.col("b_of").alias("b")), "between"), heads.select(F.col("component").alias("node")))
    loops = links.where("a = b").select(F.col("a").alias("node"), F.lit(True).alias("loop")).distinct()
    out = joined(joined(parts, heads, "component", m), levels.withColumnRenamed("node", "component"), "component", m)
    out = joined(out, loops, "node", m, "left")
    return out.select(F.col("node").alias("file"), "component", "n_files", ((F.col("n_files") > 1) | F.coalesce("loop", F.lit(False))).alias("in_cycle"), "level")
