"""Rank tests against the enumeration of all orders."""

import random
from itertools import combinations

from codeloom.operators import stats


def test_counts_are_those_of_all_orders():
    for a in range(1, 5):
        for b in range(a, 6):
            counts = [0] * (a * b + 1)
            for places in combinations(range(a + b), a):
                counts[sum(p - i for i, p in enumerate(places))] += 1
            assert list(stats.u_counts(a, b)) == counts
    assert sum(stats.u_counts(8, 30)) == 48903492


def test_groups(spark):
    rng = random.Random(2)
    rows = [(g, c, rng.random() + (c == "x") * 0.3 if g != "tied" else float(rng.randint(0, 3))) for g, n in (("small", 5), ("large", 40), ("tied", 6), ("one", 1), (None, 4)) for c in ("x", "y", "other") for _ in range(n)]
    rows += [("same", c, 1.0) for c in "xyxy"] + [("nulls", "x", None), ("alone", "x", 1.0), ("alone", "x", 2.0)]
    df = spark.createDataFrame(rows, "g string, c string, v double").repartition(4)
    found = {r.g: r for r in stats.rank_tests(df, ["g"], "c", "x", "y", "v").collect()}
    for g, r in found.items():
        xs, ys = ([v for k, c, v in rows if k == g and c == w and v is not None] for w in "xy")
        u = sum((x > y) + (x == y) / 2 for x in xs for y in ys)
        assert (r.n1, r.n2) == (len(xs), len(ys)) and abs(r.u - u) < 1e-9
        if r.exact and r.p is not None:
            every = sorted(xs + ys)
            us = [sum(every[i] > every[j] for i in part for j in range(len(every)) if j not in part) for part in combinations(range(len(every)), len(xs))]
            top = max(u, len(xs) * len(ys) - u)
            assert abs(r.p - min(1.0, 2 * sum(x >= top for x in us) / len(us))) < 1e-12
    assert found["small"].exact and not found["large"].exact and not found["tied"].exact and 0 < found["large"].p < 1
    assert found["one"].p is None and found["same"].p is None and found["alone"].p is None and "nulls" not in found
    assert stats.rank_tests(df.limit(0), ["g"], "c", "x", "y", "v").collect() == []
