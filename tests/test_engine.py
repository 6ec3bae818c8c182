"""Extraction, transcripts, statistics, maintenance and streams on small inputs."""

import json
import math

import pytest

from codeloom.operators import graph, joins, maintenance, stats
from codeloom.operators import symbols as S
from codeloom.sources import extract, files
from codeloom.streaming import changes
from codeloom.telemetry import calls as C

TREE = {
    "lib/shape.ts": "export interface Shape { area(): number }\nexport class Square implements Shape {\n  area() { return side(2); }\n}\nexport function side(n: number) { return n; }\n",
    "app/main.ts": "import { Square, side as s } from '../lib/shape';\nfunction run() { const x = new Square(); return s(1); }\n",
    "py/base.py": "class Base:\n    def go(self):\n        return helper()\n\n\ndef helper():\n    return 'é'\n",
    "py/child.py": "from .base import Base, helper as h\n\n\nclass Child(Base):\n    def go(self):\n        return h()\n",
    "rs/lib.rs": "pub trait Walk { fn walk(&self); }\npub struct Dog;\nimpl Walk for Dog { fn walk(&self) { bark(); } }\nfn bark() {}\n#[test]\nfn test_bark() { bark(); }\n",
    "go/a.go": "package a\n\ntype Cat struct {\n\tname string\n}\n\nfunc (c Cat) Say() { hello() }\n\nfunc hello() {}\n",
    "kt/A.kt": "interface Run\nclass Fast : Run {\n  fun go() { stop() }\n  fun stop() {}\n}\n",
    "cs/A.cs": "namespace N {\n  public interface IRun {}\n  public class Car : IRun {\n    public void Go() { Stop(); }\n    public void Stop() {}\n  }\n}\n",
    "cpp/a.cpp": '#include "b.h"\nclass Base {};\nclass Derived : public Base {\n};\nint add(int a, int b) {\n  return a + b;\n}\n',
    "rb/a.rb": "module M\n  class Dog < Animal\n    def bark\n      loud\n    end\n  end\nend\n",
    "node_modules/x.ts": "class Hidden {}\n",
    "readme.md": "class Text {}\n",
}


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for p, t in TREE.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(t)
    return str(root), extract.index_tables(files.scan_workspace(spark, str(root)))


def test_symbols_of_all_languages(index):
    root, t = index
    got = {(r.file[len(root) + 1 :], r.kind, r.name) for r in t["symbols"].collect()}
    want = {("lib/shape.ts", "interface", "Shape"), ("lib/shape.ts", "class", "Square"), ("lib/shape.ts", "function", "side"), ("app/main.ts", "function", "run"), ("py/base.py", "class", "Base"), ("py/base.py", "method", "go"), ("py/base.py", "function", "helper"), ("rs/lib.rs", "trait", "Walk"), ("rs/lib.rs", "struct", "Dog"), ("rs/lib.rs", "function", "bark"), ("go/a.go", "struct", "Cat"), ("go/a.go", "method", "Say"), ("kt/A.kt", "interface", "Run"), ("kt/A.kt", "class", "Fast"), ("kt/A.kt", "method", "stop"), ("cs/A.cs", "class", "Car"), ("cs/A.cs", "method", "Stop"), ("cpp/a.cpp", "class", "Derived"), ("cpp/a.cpp", "function", "add"), ("rb/a.rb", "class", "Dog"), ("rb/a.rb", "method", "bark")}
    assert want <= got and not any("node_modules" in f or f.endswith(".md") for f, _, _ in got)


def test_edges_across_files(index):
    _, t = index
    names = {r.id: r.name for r in t["symbols"].collect()}
    got = {(names.get(r.src, r.src), names.get(r.dst, r.dst.rpartition("#")[2]), r.kind) for r in t["edges"].collect()}
    assert {("Square", "Shape", "implements"), ("run", "side", "calls"), ("Child", "Base", "extends"), ("go", "helper", "calls"), ("Say", "hello", "calls"), ("go", "stop", "calls"), ("Car", "IRun", "implements"), ("Derived", "Base", "extends"), ("Dog", "Animal", "extends"), ("test_bark", "bark", "calls")} <= got
    deps = {(r.from_file.rpartition("/")[2], r.to_file.rpartition("/")[2]) for r in t["dependencies"].collect()}
    assert {("main.ts", "shape.ts"), ("child.py", "base.py")} <= deps
    assert any(names.get(r.symbol_id) == "side" and r.file.endswith("main.ts") for r in t["references"].collect())


def test_python_positions_are_bytes(index):
    _, t = index
    r = t["symbols"].where("name = 'helper'").first()
    text = TREE["py/base.py"].encode()
    assert text[r.start_pos : r.end_pos].decode() == "def helper():\n    return 'é'"


def test_registered_extractor():
    extract.register("go", lambda p, t: {"path": p, "symbols": [], "edges": [("a", "b", "calls")], "refs": [], "imports": []})
    try:
        assert extract.extract_file("x.go", "")["edges"] == [("a", "b", "calls")]
    finally:
        extract.REGISTRY.clear()
    assert extract.extract_file("bad.py", "def (:")["symbols"] == []


def test_implementation_tiers(spark):
    symbols = spark.createDataFrame([("a", "X", "f1"), ("b", "X", "f2"), ("c", "X", "f3"), ("d", "Y", "f1"), ("e", "Z", "f9"), ("z", "Z", "f8")], "id string, name string, file string")
    edges = spark.createDataFrame([("e", "d", "implements")], "src string, dst string, kind string")
    deps = spark.createDataFrame([("f2", "f1", "import")], "from_file string, to_file string, kind string")
    got = {tuple(r) for r in joins.implementations(edges, symbols, symbols.where("id in ('a', 'd', 'e')"), deps).collect()}
    assert got == {("a", "b", 2), ("d", "e", 1), ("e", "z", 3)}


def test_name_positions(spark):
    df = spark.createDataFrame([("f", "the then the_x (the) the"), ("g", "none")], "file string, content string")
    assert sorted((r.file, r.start_pos) for r in joins.name_positions(df, "the").collect()) == [("f", 0), ("f", 16), ("f", 21)]


def test_cycles(spark):
    deps = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a"), ("d", "e"), ("e", "e")], "from_file string, to_file string")
    nodes = spark.createDataFrame([(x,) for x in "abcdef"], "file string")
    assert {r.file: r.level for r in graph.topological_levels(deps, nodes).collect()} == {"a": -1, "b": -1, "c": -1, "e": 0, "f": 0, "d": 1}
    start = spark.createDataFrame([("a",)], "node string")
    assert {(r.node, r.depth) for r in graph.dependents(deps, start).collect()} == {("a", 0), ("b", 1), ("c", 1)}


def test_paging(spark):
    df = spark.createDataFrame([(f"s{k:02d}",) for k in range(10)], "id string")
    sizes, cursor = [], None
    while True:
        rows, cursor = S.page(df, 3, cursor)
        sizes.append(len(rows))
        if cursor is None:
            break
    assert sizes == [3, 3, 3, 1]


def test_full_text_errors(spark):
    df = spark.createDataFrame([("a", "getUser", "mod")], "id string, name string, qualifier string")
    with pytest.raises(ValueError):
        S.full_text(df, " ")
    for query in ("user NOT get", "(user OR get)", "NOT user"):
        with pytest.raises(ValueError):
            S.full_text(df, query)
    assert S.full_text(df, '"x OR y" OR "user"').count() == 1
    assert S.full_text(df, "ge").count() == 0 and S.full_text(df, "tus*").count() == 1 and S.full_text(df, "name:mod").count() == 0


def test_published_welch(spark):
    from pyspark.sql import functions as F

    out = stats.welch(*[F.lit(x) for x in (45.4, 43.3, 400, 30.6, 34.9, 400)])
    r = spark.range(1).select(*[c.alias(k) for k, c in out.items()]).first()
    assert (round(r.t, 2), round(r.df, 1), round(r.d, 3), round(r.low, 2), round(r.high, 2)) == (5.32, 763.6, 0.376, 9.24, 20.36) and r.stars == "***"
    r = spark.range(1).select(*[c.alias(k) for k, c in stats.welch(*[F.lit(x) for x in (2.0, 0.0, 3, 1.0, 0.0, 3)]).items()]).first()
    assert math.isinf(r.t) and r.df == 4


def test_transcripts(spark, tmp_path):
    m = {"session_id": "s", "messages": [{"role": "user", "content": "do it"}, {"role": "assistant", "content": [{"type": "text", "text": "ok"}, {"type": "tool_use", "id": "t1", "name": "Grep", "input": {"pattern": "x"}}]}, {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1", "content": "abcdefgh"}]}]}
    (tmp_path / "a.json").write_text(json.dumps(m))
    blocks = C.load_messages(spark, str(tmp_path / "a.json"))
    r = C.tool_calls(blocks).first()
    assert (r.tool_name, r.result, r.result_tokens, r.tool_input["pattern"]) == ("Grep", "abcdefgh", 2, "x")
    lines = [{"type": "queue-operation"}, *[{"type": x["role"], "sessionId": "n", "message": x} for x in m["messages"]]]
    (tmp_path / "b.jsonl").write_text("\n".join(map(json.dumps, lines)))
    assert C.is_native(spark, str(tmp_path / "b.jsonl")) and not C.is_native(spark, str(tmp_path / "a.json"))
    assert C.tool_calls(C.load_native(spark, str(tmp_path / "b.jsonl"))).count() == 1


@pytest.mark.parametrize(
    "command, want",
    [
        ("grep -rn 'def x' src", ("grep", "def x", "src", True)),
        ("rg foo", ("grep", "foo", None, True)),
        ("find . -name '*.py' -exec grep -l foo {} \\;", ("find", "foo", ".", True)),
        ("cat a.py", ("read", None, "a.py", False)),
        ("echo 'open", ("other", None, None, False)),
        (None, ("other", None, None, False)),
    ],
)
def test_shell(command, want):
    assert C.shell_info(command)[:4] == want


def test_stream_of_changes(spark, tmp_path):
    base, feed = str(tmp_path / "index"), tmp_path / "feed"
    feed.mkdir()
    start = spark.createDataFrame([(f"f{k}", 1) for k in range(40)] + [("a", 1), ("b", 1)], "file string, version int")
    changes.create(start, base, buckets=8)
    before = changes.manifest(spark, base)
    (feed / "1.json").write_text("\n".join(json.dumps(x) for x in [{"path": "a", "op": "modify", "seq": 1}, {"path": "b", "op": "modify", "seq": 2}, {"path": "b", "op": "delete", "seq": 3}, {"path": "c", "op": "create", "seq": 4}]))
    extract_rows = lambda paths: paths.selectExpr("path as file", "2 as version")
    changes.watch(spark, str(feed), base, extract_rows, str(tmp_path / "cp"), once=True).awaitTermination()
    want = sorted([(f"f{k}", 1) for k in range(40)] + [("a", 2), ("c", 2)])
    assert sorted(map(tuple, changes.table(spark, base).collect())) == want
    after = changes.manifest(spark, base)
    assert sum(before["parts"].get(b) != p for b, p in after["parts"].items()) <= 3
    # the batch again, as after a crash between the commit and the stream's own record
    batch = spark.createDataFrame([("a", "delete", 1)], "path string, op string, seq long")
    assert not changes.apply_changes(spark, base, batch, extract_rows, after["batch"])
    assert sorted(map(tuple, changes.table(spark, base).collect())) == want
    assert changes.apply_changes(spark, base, batch, extract_rows, after["batch"] + 1)
    assert sorted(map(tuple, changes.table(spark, base).collect())) == [x for x in want if x[0] != "a"]


def test_meta(spark):
    meta = spark.createDataFrame([("schema_version", "1.2")], "key string, value string")
    assert not maintenance.ready(meta)
    meta = maintenance.meta_set(maintenance.meta_set(meta, "initial_index_complete", "false"), "initial_index_complete", "true")
    assert maintenance.ready(meta) and meta.count() == 2 and maintenance.meta_get(meta, "schema_version").first()[0] == "1.2"
    assert maintenance.meta_delete(meta, "schema_version").count() == 1


def test_outline_of_deep_and_cyclic_containers(spark):
    rows = [("f", f"i{k}", f"n{k}", f"n{k - 1}" if k else None, k) for k in range(25)] + [("f", "x", "p", "q", 100), ("f", "y", "q", "p", 101), ("f", "z", "r", "q", 102)]
    got = {r.id: r.depth for r in stats.outline(spark.createDataFrame(rows, "file string, id string, name string, container string, start_pos long")).collect()}
    assert got == {**{f"i{k}": k for k in range(25)}, "x": 0, "y": 0, "z": 0}


def test_narrowest_of_long_and_short_spans(spark):
    import random

    rng = random.Random(5)
    spans = [("f", a, a + rng.choice([1, 50, 3000, 200_000, 40_000_000]), f"s{k:03d}") for k, a in enumerate(rng.randrange(0, 5_000_000) for _ in range(150))]
    probes = [(k, rng.choice("fg"), rng.randrange(0, 6_000_000)) for k in range(200)] + [(1000 + k, "f", s[1]) for k, s in enumerate(spans[:50])]
    want = {}
    for k, f, at in probes:
        hit = [(b - a, a, i) for g, a, b, i in spans if g == f and a <= at < b]
        if hit:
            want[k] = min(hit)[2]
    got = joins.narrowest(spark.createDataFrame(probes, "probe_id long, file string, offset long"), spark.createDataFrame(spans, "file string, start_pos long, end_pos long, id string"))
    assert {r.probe_id: r.id for r in got.collect()} == want


def test_p_of_t(spark):
    from pyspark.sql import functions as F

    # published values of Student's t: t, degrees of freedom, two-sided p
    known = [(2.228, 10, 0.05), (12.706, 1, 0.05), (2.0, 60, 0.05003), (3.291, 1e6, 0.001), (0.0, 5, 1.0), (-2.845, 20, 0.01)]
    got = spark.createDataFrame([(float(t), float(n), p) for t, n, p in known], "t double, n double, p double").select("p", stats.p_of_t(F.col("t"), F.col("n")).alias("q")).collect()
    assert all(abs(r.p - r.q) < 2e-4 for r in got)


def test_imports(spark):
    from pyspark.sql import functions as F

    from codeloom.functions import imports as I

    files = spark.createDataFrame([(x,) for x in ("/w/src/lib.rs", "/w/src/a.rs", "/w/src/b/mod.rs", "/w/src/b/c.rs", "/t/x.ts", "/t/y/index.tsx")], "file string")
    ts = [(1, "/t/z.ts", "'./x'", "/t/x.ts"), (2, "/t/z.ts", "./y", "/t/y/index.tsx"), (3, "/t/u/z.ts", "../none", "/t/none"), (4, "/t/z.ts", "react", None)]
    rows = spark.createDataFrame([x[:3] for x in ts], "k int, file string, s string")
    c = I.import_candidates(F.col("file"), F.col("s"))
    assert {r.k: r.resolved for r in I.first_existing(rows, "k", c, files, F.get(c, F.lit(0))).collect()} == {x[0]: x[3] for x in ts}
    rs = [(1, "/w/src/a.rs", "crate::b::X", "/w/src/b/mod.rs"), (2, "/w/src/b/c.rs", "super::a::Y", "/w/src/a.rs"), (3, "/w/src/main.rs", "w::Z", "/w/src/lib.rs"), (4, "/w/src/a.rs", "self::q", None), (5, "/w/src/lib.rs", "a", "/w/src/a.rs"), (6, "/w/src/a.rs", "std::io", None), (7, "/w/src/a.rs", "crate", "/w/src/lib.rs")]
    rows = spark.createDataFrame([x[:3] for x in rs], "k int, file string, u string")
    c = I.module_candidates(F.col("u"), F.col("file"), F.lit("/w/src"))
    assert {r.k: r.resolved for r in I.first_existing(rows, "k", c, files).collect()} == {x[0]: x[3] for x in rs}
    got = spark.createDataFrame([(x,) for x in (12.34, 61.0, 3725.0)], "s double").select(I.duration(F.col("s"))).collect()
    assert [r[0] for r in got] == ["12.3s", "1m 1s", "1h 2m"]


def test_versions():
    assert [maintenance.schema_state(x, "1.2") for x in (None, "1.0", "0.9", "2.0")] == ["missing", "ok", "older", "newer"]
