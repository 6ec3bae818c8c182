"""Strong components and build order against plain versions, and the rounds that long chains take."""

import random

import pytest

from codeloom.functions.text import glob_match
from codeloom.operators import graph, ordering


def plain_components(nodes, links):
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in links:
            reach[a] |= reach[b]
    return {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}


def plain_levels(parts, links):
    out = {}

    def level(p):
        if p not in out:
            out[p] = max((level(parts[b]) + 1 for a, b in links if parts[a] == p != parts[b]), default=0)
        return out[p]

    return {n: level(p) for n, p in parts.items()}


def order(spark, nodes, links):
    deps = spark.createDataFrame(links, "from_file string, to_file string")
    files = spark.createDataFrame([(n,) for n in nodes], "file string")
    return {r.file: (r.component, r.n_files, r.in_cycle, r.level) for r in ordering.build_order(deps, files).collect()}


def wanted(nodes, links):
    links = [(a, b) for a, b in links if a in nodes and b in nodes]
    parts = plain_components(nodes, links)
    levels = plain_levels(parts, links)
    sizes = {p: sum(x == p for x in parts.values()) for p in parts.values()}
    return {n: (parts[n], sizes[parts[n]], sizes[parts[n]] > 1 or (n, n) in links, levels[n]) for n in nodes}


def test_random_graphs(spark):
    """Sparse, dense, cyclic; several graphs side by side in one table."""
    rng = random.Random(3)
    nodes, links = [], []
    for g, (n, m, back) in enumerate([(12, 14, 0.0), (10, 24, 0.0), (12, 16, 0.3), (9, 20, 0.4), (5, 0, 0)]):
        own = [f"g{g}n{i:02}" for i in range(n)]
        for _ in range(m):
            a, b = sorted(rng.sample(range(n), 2), reverse=rng.random() > back)
            links.append((own[a], own[b]))
        # a chain of diamonds, whose links become single ones
        diamonds = [f"g{g}d{i}" for i in range(7)]
        links += [(diamonds[i], diamonds[i + 1]) for i in (0, 2, 3, 5)] + [(diamonds[0], diamonds[2]), (diamonds[1], diamonds[3]), (diamonds[2], diamonds[4]), (diamonds[4], own[0])]
        nodes += own + diamonds
    links += [(nodes[0], nodes[0]), ("not listed", nodes[1]), (nodes[2], None)]
    assert order(spark, nodes, links) == wanted(nodes, links)


def test_what_lies_behind_a_cycle(spark):
    nodes = ["a", "b", "c", "behind", "far", "self"]
    links = [("a", "b"), ("b", "c"), ("c", "a"), ("behind", "a"), ("far", "behind"), ("self", "self")]
    assert order(spark, nodes, links) == {"a": ("a", 3, True, 0), "b": ("a", 3, True, 0), "c": ("a", 3, True, 0), "behind": ("behind", 1, False, 1), "far": ("far", 1, False, 2), "self": ("self", 1, True, 0)}


def test_long_chain_and_long_cycle_take_few_rounds(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(ordering, "kept", lambda df, name, f=ordering.kept: (tables.append(name), f(df, name))[1])
    n = 4000
    chain = [(f"c{i:04}", f"c{i - 1:04}") for i in range(1, n)]
    cycle = [(f"r{i:03}", f"r{(i + 1) % 90:03}") for i in range(90)]
    nodes = [f"c{i:04}" for i in range(n)] + [f"r{i:03}" for i in range(90)]
    found = order(spark, nodes, chain + cycle)
    assert all(found[f"c{i:04}"][3] == i for i in range(n))
    assert {found[f"r{i:03}"] for i in range(90)} == {("r000", 90, True, 0)}
    assert len(tables) < 120


@pytest.mark.parametrize(("pattern", "text", "want"), [("ab*b", "ab", True), ("a*b*c", "abc", True), ("a*b*c", "acb", False), ("*b", "ab", True), ("a*", "b", False), ("a.c", "abc", False), ("*", "", True)])
def test_glob(spark, pattern, text, want):
    from pyspark.sql import functions as F

    assert spark.range(1).select(glob_match(F.lit(text), pattern).alias("x")).first().x is want


def test_rounds_send_nothing_to_the_driver_and_deal_by_rows(spark, monkeypatch):
    plans, kept = [], ordering.kept

    def noted(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df, name)

    monkeypatch.setattr(ordering, "kept", noted)
    monkeypatch.setattr(graph, "ROWS", 16, raising=False)
    links = [(f"n{k:03d}", f"n{k - 1:03d}") for k in range(1, 100)] + [("n020", "n029"), ("n099", "n050")]
    deps = spark.createDataFrame(links, "from_file string, to_file string")
    files = spark.createDataFrame([(f"n{k:03d}",) for k in range(100)], "file string")
    out = ordering.build_order(deps, files)
    rows = {r.file: (r.component, r.n_files, r.in_cycle, r.level) for r in out.collect()}
    want = {k: (f"n{k:03d}", 1, False, k) for k in range(20)}
    want |= {k: ("n020", 10, True, 20) for k in range(20, 30)}
    want |= {k: (f"n{k:03d}", 1, False, k - 9) for k in range(30, 100)}
    assert rows == {f"n{k:03d}": v for k, v in want.items()}
    assert plans and not any("Broadcast" in p for p in plans)
    assert any("REPARTITION_BY_NUM" in p for p in plans)
