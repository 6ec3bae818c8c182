"""Lines and columns of offsets, against counting in the text."""

import re

from pyspark.sql import functions as F

from codeloom.operators import positions

TEXTS = {"a": "one\ntwo é two\n\nlast", "b": "", "c": "\n\n", "d": "x" * 200_000 + "\n" + "y\n" * 3000, "e": None}


def test_positions(spark):
    sources = spark.createDataFrame(list(TEXTS.items()), "path string, content string")
    for in_bytes in (True, False):
        lines = positions.line_table(sources, in_bytes)
        probes, want = [], {}
        for f, t in TEXTS.items():
            t = (t or "").encode() if in_bytes else t or ""
            feed = b"\n" if in_bytes else "\n"
            for at in {0, 1, 3, 4, 7, 9, 10, len(t) // 2, len(t) - 1, len(t), len(t) + 1}:
                probes.append((f"{f}{at}", f, at))
                inside = TEXTS[f] is not None and 0 <= at <= len(t)
                want[f"{f}{at}"] = (t[:at].count(feed) + 1, at - (t[:at].rfind(feed) + 1) + 1) if inside else (None, None)
        found = positions.located(spark.createDataFrame(probes, "probe_id string, file string, offset long"), lines)
        assert {r.probe_id: (r.line, r.col) for r in found.collect()} == want


def test_context(spark):
    sources = spark.createDataFrame(list(TEXTS.items()), "path string, content string")
    lines = positions.line_table(sources)
    probes = spark.createDataFrame([("p", "a", 4), ("q", "a", 0), ("r", "a", 999), ("s", "c", 1)], "probe_id string, file string, offset long")
    got = {r.probe_id: (r.first_line, r.snippet) for r in positions.with_context(positions.located(probes, lines), lines, 1).collect()}
    assert got == {"p": (1, "one\ntwo é two\n"), "q": (1, "one\ntwo é two"), "s": (1, "\n\n")}
    assert positions.line_table(sources.limit(0)).collect() == []


def test_texts_are_exchanged_by_lines_not_by_probes(spark):
    split = [f"{m:05d}" * 20 for m in range(30)]
    docs = spark.createDataFrame([(f"/f{k}", "\n".join(split)) for k in range(5)], "path string, content string")
    probes = docs.select(F.col("path").alias("file"), F.explode(F.sequence(F.lit(0).cast("long"), F.length("content").cast("long"), F.lit(3).cast("long"))).alias("offset")).withColumn("probe_id", F.concat_ws("#", "file", "offset"))
    lines = positions.line_table(docs)
    out = positions.with_context(positions.located(probes, lines), lines, 1)
    want = {f"/f{k}#{x}": (max(x // 101, 1), "\n".join(split[max(x // 101 - 1, 0) : x // 101 + 2])) for k in range(5) for x in range(0, 30 * 101, 3)}
    assert {r.probe_id: (r.first_line, r.snippet) for r in out.collect()} == want
    told = lambda df: df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not any("Aggregate" in x and "collect_list" in x for x in told(out))
    assert not any("Project" in x and re.search(r"[\[ ]text#\d+[,\]]", x) for x in told(lines.select("file", "start_pos", "end_pos")))
