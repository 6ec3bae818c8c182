"""Counts, duplicate groups, outlines and sample statistics."""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import dealt, kept


def file_stats(symbols: DataFrame) -> DataFrame:
    n = lambda k: F.count_if(F.col("kind") == k)
    return symbols.groupBy("file").agg(F.count("*").alias("symbols"), n("function").alias("functions"), n("class").alias("classes"), n("interface").alias("interfaces"))


def duplicate_groups(symbols: DataFrame, least: int = 2, kind: str | None = None, files: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """(content_hash, n, id) of symbols with equal content. The conditions choose the hashes;
    members are all symbols with these hashes, unless ``strict``."""
    chosen = symbols.where("content_hash is not null")
    chosen = chosen.where(F.col("kind") == kind) if kind else chosen
    chosen = chosen.join(files, "file", "left_semi") if files is not None else chosen
    groups = chosen.groupBy("content_hash").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return (chosen if strict else symbols).join(groups, "content_hash").select("content_hash", "n", "id")


def edge_multiplicity(edges: DataFrame, rows: int = 0) -> DataFrame:
    """How often each edge is there; ``rows``, about how many edges there are, gives the parts (0: the session's)."""
    return dealt(edges, rows, "src", "dst", "kind").groupBy("src", "dst", "kind").agg(F.count("*").alias("n"))


def key_types(symbols: DataFrame, per_file: int = 5, methods: int = 3) -> DataFrame:
    """The types of each file with the most methods."""
    n = symbols.where("kind in ('method', 'function') and container is not null").groupBy("file", F.col("container").alias("name")).agg(F.count("*").alias("methods"))
    t = symbols.where("kind in ('class', 'interface', 'struct', 'enum', 'trait') and visibility in ('pub', 'public')").select("file", "name").distinct().join(n.where(F.col("methods") >= methods), ["file", "name"])
    return t.withColumn("rank", F.row_number().over(W.partitionBy("file").orderBy(F.desc("methods"), "name"))).where(F.col("rank") <= per_file)


def outline(symbols: DataFrame) -> DataFrame:
    """(file, id, depth, path): each symbol under the first symbol of its file whose name is its
    container; symbols without one are roots. ``path`` sorts parents before children, children by
    place. Symbols whose containers form a cycle, and those below them, are roots too.

    One round a level; each level is stored, so none is computed again.
    """
    s = symbols.select("file", "id", "name", "container", "start_pos")
    parent = s.groupBy("file", F.col("name").alias("container")).agg(F.min(F.struct("start_pos", "id"))["id"].alias("parent"))
    s = s.join(parent, ["file", "container"], "left").withColumn("parent", F.when(F.col("parent") != F.col("id"), F.col("parent")))
    mark = F.concat(F.lpad(F.col("start_pos").cast("string"), 12, "0"), F.lit("|"), "id")
    s = kept(s.select("file", "id", "parent", mark.alias("mark")), "outline")
    root = lambda t: t.select("file", "id", F.lit(0).alias("depth"), F.col("mark").alias("path"))
    level, depth = kept(root(s.where("parent is null")), "level"), 0
    out, rest = level, s.where("parent is not null")
    while True:
        depth += 1
        up = level.select("file", F.col("id").alias("parent"), F.col("path").alias("up"))
        level = kept(rest.join(up, ["file", "parent"]).select("file", "id", F.lit(depth).alias("depth"), F.concat("up", F.lit("/"), "mark").alias("path")), "level")
        if level.isEmpty():
            return out.union(root(s.join(out.select("file", "id"), ["file", "id"], "left_anti")))
        out = out.union(level)


def sample_stats(value: str | Column, prefix: str = "", digits: int | None = 2) -> list[Column]:
    """Mean, sample deviation (0 for one value), least and most."""
    v = F.col(value) if isinstance(value, str) else value
    cut = lambda c: c if digits is None else F.round(c, digits)
    return [cut(F.coalesce(c, F.lit(0.0))).alias(prefix + n) for n, c in (("mean", F.avg(v)), ("std", F.stddev_samp(v)), ("min", F.min(v).cast("double")), ("max", F.max(v).cast("double")))]


def zero_filled_stats(rows: DataFrame, key: str, value: str, total: int, digits: int = 2) -> DataFrame:
    """As ``sample_stats`` by ``key``, where ``total`` values belong to each key and absent ones are 0."""
    t = rows.groupBy(key).agg(F.count("*").alias("_k"), F.sum(value).alias("_s"), F.sum(F.col(value) * F.col(value)).alias("_q"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    mean, zero = F.col("_s") / total, F.lit(0.0)
    std = F.sqrt(F.greatest(zero, F.col("_q") - total * mean * mean) / (total - 1)) if total > 1 else zero
    absent = F.col("_k") < total
    return t.select(key, F.round(mean, digits).alias("mean"), F.round(std, digits).alias("std"), F.round(F.when(absent, F.least(zero, "_lo")).otherwise(F.col("_lo")), digits).alias("min"), F.round(F.when(absent, F.greatest(zero, "_hi")).otherwise(F.col("_hi")), digits).alias("max"))


def welch(m1: Column, s1: Column, n1: Column, m2: Column, s2: Column, n2: Column) -> dict[str, Column]:
    """Difference, t, degrees of freedom, 95 % interval and effect size of two samples."""
    v1, v2 = s1 * s1 / n1, s2 * s2 / n2
    se, diff = F.sqrt(v1 + v2), m1 - m2
    flat = (s1 == 0) & (s2 == 0)
    t = F.when(flat, F.when(diff == 0, F.lit(0.0)).otherwise(F.lit(math.inf) * F.signum(diff))).otherwise(diff / se)
    df = F.when(flat, n1 + n2 - 2).otherwise((v1 + v2) * (v1 + v2) / (v1 * v1 / (n1 - 1) + v2 * v2 / (n2 - 1)))
    star = F.when(df > 30, F.lit(2.0)).otherwise(F.lit(2.1))
    pooled = F.sqrt((s1 * s1 + s2 * s2) / 2)
    d = F.when(pooled > 0, diff / pooled).otherwise(F.lit(0.0))
    return {"diff": diff, "t": t, "df": df.cast("double"), "low": diff - star * se, "high": diff + star * se, "d": d, "effect": effect_label(d), "stars": stars_by_t(t)}


def effect_label(d: Column) -> Column:
    a = F.abs(d)
    return F.when(a >= 1.0, "very large").when(a >= 0.8, "large").when(a >= 0.5, "medium").when(a >= 0.2, "small").otherwise("negligible")


def stars_by_t(t: Column) -> Column:
    a = F.abs(t)
    return F.when(a > 4, "***").when(a > 3, "**").when(a > 2, "*").otherwise("")


def stars_by_p(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


#: Coefficients of Lanczos' series for the logarithm of the gamma function (g = 7).
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def log_gamma(x: Column) -> Column:
    """For x of at least one half."""
    total = F.lit(_LANCZOS[0])
    for k, c in enumerate(_LANCZOS[1:]):
        total = total + F.lit(c) / (x + k)
    t = x + 6.5
    return 0.5 * math.log(2 * math.pi) + (x - 0.5) * F.log(t) - t + F.log(total)


def _beta_fraction(x: Column, a: Column, b: Column, steps: int = 300) -> Column:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    away = lambda v: F.when(F.abs(v) < tiny, F.lit(tiny)).otherwise(v)
    d0 = 1 / away(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("f"))

    def step(s: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        half = lambda s, n: F.struct(away(1 + n / s["c"]).alias("c"), (1 / away(1 + n * s["d"])).alias("d"), s["f"].alias("f"))
        grown = lambda s: F.struct(s["c"].alias("c"), s["d"].alias("d"), (s["f"] * s["c"] * s["d"]).alias("f"))
        # both halves of a step as folds, so that no half is written out twice
        return F.aggregate(F.array(even, odd), s, lambda acc, n: F.aggregate(F.array(half(acc, n)), acc, lambda _, h: grown(h)))

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda m: m.cast("double")), start, step)["f"]


def incomplete_beta(x: Column, a: Column, b: Column) -> Column:
    """The regularised incomplete beta function, for a and b of at least one half."""
    front = lambda x, a, b: F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1 - x)) / a
    near = front(x, a, b) * _beta_fraction(x, a, b)
    far = 1 - front(1 - x, b, a) * _beta_fraction(1 - x, b, a)
    return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).when(x < (a + 1) / (a + b + 2), near).otherwise(far)


def p_of_t(t: Column, df: Column) -> Column:
    """The two-sided p-value of Student's t; df of at least 1."""
    return incomplete_beta(df / (df + t * t), df / 2, F.lit(0.5))


def total_tokens(tokens_in: Column, tokens_out: Column, cache_read: Column, cache_write: Column, cached: bool = True) -> Column:
    return tokens_in + tokens_out + (cache_read + cache_write if cached else F.lit(0))


def change(base: Column, new: Column) -> list[Column]:
    return [(new - base).alias("delta"), F.when(base == 0, F.lit(0.0)).otherwise((new - base) / base * 100).alias("pct")]


def cost(tokens_in: Column, tokens_out: Column, cache_read: Column, cache_write: Column) -> Column:
    """Dollars for a million tokens of each kind."""
    return (3.0 * tokens_in + 15.0 * tokens_out + 0.30 * cache_read + 3.75 * cache_write) / 1_000_000


def mann_whitney(rows: DataFrame, group: str, first: str, second: str, value: str) -> DataFrame:
    """U of the first group, and the two-sided p by the normal approximation with ties.

    Ranks come from counts of equal values and the counts below them: one row a different value,
    so large samples are grouped before anything is ordered.
    """
    n = lambda g: F.count_if(F.col(group) == g)
    v = rows.where(F.col(group).isin(first, second)).groupBy(value).agg(n(first).alias("a"), n(second).alias("b"))
    below = F.coalesce(F.sum(F.col("a") + F.col("b")).over(W.orderBy(value).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    tied = F.col("a") + F.col("b")
    v = v.select("a", "b", (below + (tied + 1) / 2).alias("rank"), (tied * tied * tied - tied).cast("double").alias("ties"))
    s = v.agg(F.sum(F.col("a") * F.col("rank")).alias("r"), F.sum("a").alias("n1"), F.sum("b").alias("n2"), F.sum("ties").alias("ties"))
    n1, n2 = F.col("n1"), F.col("n2")
    u, total = F.col("r") - n1 * (n1 + 1) / 2, n1 + n2
    sd = F.sqrt(n1 * n2 / 12.0 * ((total + 1) - F.col("ties") / (total * (total - 1))))
    return s.select("n1", "n2", u.alias("u"), F.when(sd > 0, (F.abs(u - n1 * n2 / 2.0) - 0.5) / sd).otherwise(0.0).alias("z"))


#: Fixed value: the smaller sample's size up to which U's distribution is counted; and places of U
#: up to which it is, as the count holds one number for each.
EXACT, MOST_PLACES = 8, 100_000


@lru_cache(maxsize=256)
def u_counts(n1: int, n2: int) -> tuple[int, ...]:
    """How many orders of n1 and n2 different values have each U, from 0 to n1 * n2."""
    counts = [1] + [0] * (n1 * n2)
    for i in range(1, n1 + 1):
        for u in range(n1 * n2, n2 + i - 1, -1):
            counts[u] -= counts[u - n2 - i]
        for u in range(i, n1 * n2 + 1):
            counts[u] += counts[u - i]
    return tuple(counts)


def exact_p(n1: int, n2: int, u: float) -> float:
    """Two-sided p of U for samples without equal values."""
    counts = u_counts(min(n1, n2), max(n1, n2))
    tail = sum(counts[int(max(u, n1 * n2 - u)) :])
    return min(1.0, 2 * tail / sum(counts))


def rank_tests(rows: DataFrame, keys: list[str], group: str, first: str, second: str, value: str) -> DataFrame:
    """For each group of ``keys``: n1, n2, U of the first sample, z and the two-sided p.

    p is exact where the smaller sample has EXACT values or fewer and none are equal, else by the normal
    approximation with ties; it is null if a sample has under two values, or the values are all one. Null
    values are left out. The different values of all groups are sorted by ranges and counted by prefix sums, so
    no group and no sort needs a task of its own; a group's ranks begin where its values do, which is
    subtracted from the sums.
    """
    n = lambda g: F.count_if(F.col(group) == g)
    v = rows.where(F.col(group).isin(first, second) & F.col(value).isNotNull()).groupBy(*keys, value).agg(n(first).alias("a"), n(second).alias("b"))
    v = kept(v.repartitionByRange(*keys, value).withColumn("_part", F.spark_partition_id()), "ranks")
    running = F.coalesce(F.sum(F.col("a") + F.col("b")).over(W.partitionBy("_part").orderBy(*keys, value).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # one row a range
    parts = v.groupBy("_part").agg(F.sum(F.col("a") + F.col("b")).alias("n"))
    parts = parts.select("_part", F.coalesce(F.sum("n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    v = v.withColumn("below", running).join(F.broadcast(parts), "_part").withColumn("below", (F.col("below") + F.col("_base")).cast("decimal(20,0)"))
    tied = F.col("a") + F.col("b")
    half = F.sum(F.col("a") * (tied + 1))
    s = v.groupBy(*keys).agg(F.sum(F.col("a") * F.col("below")).alias("r"), F.min("below").alias("base"), half.alias("half"), F.sum("a").alias("n1"), F.sum("b").alias("n2"), F.sum((tied * tied * tied - tied).cast("double")).alias("ties"))
    n1, n2 = F.col("n1"), F.col("n2")
    u = (F.col("r") - F.col("base") * n1).cast("double") + F.col("half") / 2 - n1 * (n1 + 1) / 2
    total = n1 + n2
    s = s.select(*keys, "n1", "n2", u.alias("u"), F.when(total > 1, F.sqrt(n1 * n2 / 12.0 * ((total + 1) - F.col("ties") / (total * (total - 1))))).alias("sd"), "ties")
    s = s.withColumn("z", F.when(F.col("sd") > 0, (F.abs(F.col("u") - n1 * n2 / 2.0) - 0.5) / F.col("sd")))

    # one row a group of keys
    @F.udf("double")
    def p(a, b, x, ties, z):
        if a < 2 or b < 2 or z is None:
            return None
        if min(a, b) <= EXACT and ties == 0 and a * b <= MOST_PLACES:
            return exact_p(a, b, x)
        return min(1.0, math.erfc(z / math.sqrt(2)))

    exact = (F.least("n1", "n2") <= EXACT) & (F.col("ties") == 0) & (n1 * n2 <= MOST_PLACES)
    return s.select(*keys, "n1", "n2", "u", "z", exact.alias("exact"), p("n1", "n2", "u", "ties", "z").alias("p"))
