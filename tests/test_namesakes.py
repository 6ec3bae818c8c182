"""Pairs of namesakes: many of one name, without one task or a stored table that has them all."""

from pyspark.sql import functions as F

from codeloom.operators import joins
from codeloom.schema import EDGES

SYMBOLS = "id string, name string, file string"


def tables(spark, rows):
    s = spark.createDataFrame(rows, SYMBOLS)
    return spark.createDataFrame([("x", "a1", "calls"), ("b1", "a1", "calls")], EDGES), s


def test_pairs_of_one_name_are_made_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(joins, "BLOCK", 16, raising=False)
    rows = [(f"a{k}", "same", f"f{k % 3}") for k in range(200)] + [("b1", "alone", "f")]
    edges, s = tables(spark, rows)
    out = joins.implementations_or_namesakes(edges, s, s.coalesce(1)).withColumn("task", F.spark_partition_id()).collect()
    want = {("a1", "b1", 1)} | {(f"a{k}", f"a{m}", 2) for k in range(200) if k != 1 for m in range(200)}
    assert len(out) == len(want) and {(r.target_id, r.id, r.tier) for r in out} == want
    most = max(sum(r.task == t for r in out) for t in {r.task for r in out})
    assert most < 0.6 * len(out)


def test_ids_of_pairs_repeat_soon_so_that_what_is_written_is_small(spark, monkeypatch):
    monkeypatch.setattr(joins, "LIST", 8, raising=False)
    rows = [(f"a{k}", "same", "f") for k in range(200)] + [("b1", "alone", "f"), (None, "same", "f")]
    edges, s = tables(spark, rows)
    out = joins.implementations_or_namesakes(edges, s, s.where("id is not null")).where("tier = 2").withColumn("task", F.spark_partition_id()).collect()
    want = {(f"a{k}", m) for k in range(200) if k != 1 for m in [None, *(f"a{m}" for m in range(200))]}
    assert len(out) == len(want) and {(r.target_id, r.id) for r in out} == want
    gaps, seen = [], {}
    for i, r in enumerate(out):
        if (r.task, r.id) in seen:
            gaps.append(i - seen[r.task, r.id])
        seen[r.task, r.id] = i
    assert sorted(gaps)[len(gaps) * 9 // 10] <= 8


def test_namesakes_of_files_are_not_stored_as_pairs(spark, monkeypatch):
    sizes, kept = [], joins.kept

    def noted(df, name):
        sizes.append((out := kept(df, name)).count())
        return out

    monkeypatch.setattr(joins, "kept", noted)
    rows = [(f"a{k}", "same", f"f{k % 2}") for k in range(120)] + [("b1", "alone", "g"), ("c1", "far", "h"), ("c2", "far", "i"), ("d1", "dep", "h"), ("d2", "dep", "j"), ("d2", "dep", "h"), ("d2", "far", "k")]
    edges, s = tables(spark, rows)
    deps = spark.createDataFrame([("h", "j", "import")], "from_file string, to_file string, kind string")
    out = [tuple(r) for r in joins.implementations(edges, s, s, deps).collect()]
    want = {("a1", "b1", 1)} | {(f"a{k}", f"a{m}", 2) for k in range(120) if k != 1 for m in range(120) if m % 2 == k % 2 and m != k}
    want |= {("c1", "c2", 3), ("c1", "d2", 3), ("c2", "c1", 3), ("c2", "d2", 3), ("d1", "d2", 2), ("d2", "d1", 2)}
    assert sorted(out) == sorted(want)
    assert max(sizes) <= len(rows)
