"""Parts of tokens grow with the source text, not with the session's settings."""

from pyspark.sql import functions as F

from codeloom.functions.imports import first_existing, import_candidates
from codeloom.operators import fulltext, graph
from codeloom.operators.joins import narrowest
from codeloom.operators.stats import edge_multiplicity
from codeloom.sources import lexis, syntax
from codeloom.sources.syntax import symbols


def test_parts_grow_with_the_text(spark, monkeypatch):
    monkeypatch.setattr(lexis, "PART", 256, raising=False)
    files = spark.createDataFrame([(f"/f{k}.go", f"package p\n\nfunc Get{k}(n int) int {{\n\treturn n\n}}\n") for k in range(100)], "path string, content string")
    size = sum(len(r.content) for r in files.collect())
    assert lexis.tokens(files).rdd.getNumPartitions() == -(-size // 256)
    assert {r.name for r in symbols(files).collect()} == {f"Get{k}" for k in range(100)}


def test_parts_of_statements_grow_with_the_text(spark, monkeypatch):
    monkeypatch.setattr(lexis, "PART", 256, raising=False)
    monkeypatch.setattr(syntax, "PART", 256, raising=False)
    files = spark.createDataFrame([(f"/f{k}.rs", f"impl A{k} {{\n  pub fn get{k}(n: i32) -> i32 {{ n }}\n}}\n") for k in range(100)], "path string, content string")
    rows = syntax.placed(files)
    size = sum(len(r.head.encode()) for r in rows.collect())
    assert rows.rdd.getNumPartitions() == -(-size // 256)
    found = syntax.symbol_rows(rows)
    assert found.rdd.getNumPartitions() == -(-size // 256)
    assert {(r.name, r.container) for r in found.where("is_symbol").collect()} == {(f"get{k}", f"A{k}") for k in range(100)}


def test_statements_are_placed_without_an_exchange_of_tokens(spark, monkeypatch):
    monkeypatch.setattr(lexis, "PART", 256, raising=False)
    files = spark.createDataFrame([(f"/f{k}.rs", f"impl A{k} {{\n  pub fn get{k}(n: i32) -> i32 {{ n }}\n}}\n") for k in range(100)], "path string, content string")
    rows = syntax.placed(files)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    found = {(r.head, r.outer, tuple(x.head for x in r.inside or ())) for r in rows.where("file = '/f7.rs'").collect()}
    assert ("pub fn get7 ( ) -> i32 { }", "impl A7 { }", ("n : i32", "n")) in found and ("n", "pub fn get7 ( ) -> i32 { }", ()) in found


def test_imports_are_read_from_statements_placed_once(spark):
    from codeloom.plans.catalog import QUERIES

    plan = QUERIES["x_imports"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_narrowest_spans_are_found_in_parts_of_so_many_rows(spark, monkeypatch):
    monkeypatch.setattr(graph, "ROWS", 16, raising=False)
    spans = [(f"s{k}-{w}", f"f{k % 3}", k * 10, k * 10 + w) for k in range(60) for w in (8, 25, 70000)]
    probes = [(f"p{k}", f"f{k % 3}", k * 7) for k in range(90)]
    out = narrowest(spark.createDataFrame(probes, "probe_id string, file string, offset bigint"), spark.createDataFrame(spans, "id string, file string, start_pos bigint, end_pos bigint"))
    want = {p: min(((e - s, s, i) for i, g, s, e in spans if g == f and s <= at < e), default=None) for p, f, at in probes}
    assert {r.probe_id: (r.width, r.id) for r in out.collect()} == {p: (x[0], x[2]) for p, x in want.items() if x}
    assert out.rdd.getNumPartitions() > 16


def test_edges_are_counted_in_parts_of_so_many_rows(spark, monkeypatch):
    monkeypatch.setattr(graph, "ROWS", 16, raising=False)
    edges = spark.createDataFrame([(f"a{k % 50}", f"b{k % 7}", "calls") for k in range(700)], "src string, dst string, kind string")
    out = edge_multiplicity(edges, 700)
    assert out.rdd.getNumPartitions() == 44
    assert {tuple(r) for r in out.collect()} == {(f"a{k}", f"b{m}", "calls", 2) for k in range(50) for m in range(7)}


def test_imports_are_resolved_in_parts_of_so_many_rows(spark, monkeypatch):
    monkeypatch.setattr(graph, "ROWS", 16, raising=False)
    rows = spark.createDataFrame([(k, "/a/x.ts", f"./m{k}") for k in range(50)], "k int, file string, s string")
    files = spark.createDataFrame([(f"/a/m{k}.tsx",) for k in range(0, 50, 2)], "file string")
    c = import_candidates(F.col("file"), F.col("s"))
    out = first_existing(rows, "k", c, files, F.get(c, F.lit(0)))
    assert out.rdd.getNumPartitions() == 18
    assert {r.k: r.resolved for r in out.collect()} == {k: f"/a/m{k}" + (".tsx" if k % 2 == 0 else "") for k in range(50)}


def test_full_text_is_stored_and_found_in_parts_of_so_many_rows(spark, monkeypatch):
    texts = spark.createDataFrame([(f"id{k:03d}", f"get{k % 10}User", f"mod{k % 3}::user") for k in range(120)], "id string, name string, qualifier string")
    query = (fulltext.Phrase("user") & ~fulltext.Phrase("get3")) | fulltext.Phrase("mod1", start=True)
    told = lambda: {(r.id, round(r.score, 9)) for r in fulltext.search_ranked(texts, fulltext.build_index(texts), query).collect()}
    want = told()
    assert {x for x, _ in want} == {f"id{k:03d}" for k in range(120) if k % 10 != 3 or k % 3 == 1}
    stored = {}
    kept = fulltext.kept
    monkeypatch.setattr(fulltext, "kept", lambda df, name: (stored.update({name: df.rdd.getNumPartitions()}), kept(df, name))[1])
    monkeypatch.setattr(graph, "ROWS", 64, raising=False)
    assert told() == want
    assert stored["postings"] > 16 and stored["occurrences"] > 4
