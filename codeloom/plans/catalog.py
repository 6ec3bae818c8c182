"""Registered queries, one or more for each operator, with SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph, joins, maintenance, stats
from ..operators import symbols as S
from ..sources import files
from ..telemetry import calls as C
from .registry import ORACLES, QUERIES, add
from .views import Views

SYMBOL = "id, file, kind, name, start_pos, end_pos, qualifier, visibility, container, is_test"


def _symbols(df: DataFrame) -> DataFrame:
    return df.select(*SYMBOL.split(", "))


def _search(key: str, where: str, **q) -> None:
    add(key, lambda v: _symbols(S.search(v.symbols, S.Query(**q))), f"SELECT {SYMBOL} FROM v_symbols WHERE {where}")


# symbol search
add("p1_list_symbols", lambda v: _symbols(S.list_symbols(v.symbols, kind="class")), f"SELECT {SYMBOL} FROM v_symbols WHERE kind = 'class'")
_search("p2_combined", "kind = 'const' AND name ILIKE '%a%' AND (file ILIKE '/ws/parts/%' OR file ILIKE '%//ws/parts/%') AND container = 'Brand#11'", kind="const", name_contains="a", file="/ws/parts/*", scope="Brand#11")
_search("p2a_file_glob", "file ILIKE '/ws/%/tests/%'", file="/ws/*/tests/*")
_search("p2b_folder", "starts_with(file, '/ws/parts/')", file="/ws/parts/")
_search("p2c_folder_guess", "file = 'tests' OR starts_with(file, 'tests/') OR contains(file, '/tests/')", file="tests")
_search("p2d_absolute", "file = '/ws/ASIA.rs'", file="/ws/ASIA.rs")
_search("p2e_relative", "file = 'tests/customer.py' OR ends_with(file, '/tests/customer.py')", file="tests/customer.py")
_search("p2f_kind", "kind = 'function'", kind="function")
_search("p2g_exact_ci", "lower(name) = 'asia'", name="aSia", case_insensitive=True)
_search("p2h_name_glob", "name ILIKE '%00_1%'", name_pattern="*00?1*")
_search("p2i_namespace", "qualifier = 'tpch' OR starts_with(qualifier, 'tpch::')", namespace="tpch")
_search("p2i_namespace_glob", "qualifier ILIKE 'parts::%::%'", namespace="parts::*::*")
_search("p2j_scope", "container = 'Brand#2'", scope="Brand#2")
_search("p2k_keyset", "id > 'method#000000100'", after="method#000000100")
add("p3_fts_post_filters", lambda v: _symbols(S.post_filtered(S.full_text(v.symbols, "customer"), "*customer.py", "method")), f"SELECT {SYMBOL} FROM v_symbols WHERE (lower(name) LIKE '%customer%' OR lower(qualifier) LIKE '%customer%') AND file LIKE '%customer.py' AND kind = 'method'")
add("p4_glob", lambda v: v.symbols.where(T.glob_match(F.col("file"), "/ws/*/customer.*")).select("id"), "SELECT id FROM v_symbols WHERE file LIKE '/ws/%/customer.%'")
add("p5_trigram", lambda v: _symbols(S.by_trigrams(v.symbols, S.trigrams(v.symbols), "Suppl")), f"SELECT {SYMBOL} FROM v_symbols WHERE lower(name) LIKE '%suppl%' OR lower(qualifier) LIKE '%suppl%'")
add("p5_full_text", lambda v: _symbols(S.full_text(v.symbols, "name:customer FRANCE OR ^asia")), f"SELECT {SYMBOL} FROM v_symbols WHERE (lower(name) LIKE '%customer%' AND (lower(name) LIKE '%france%' OR lower(qualifier) LIKE '%france%')) OR starts_with(lower(name), 'asia') OR starts_with(lower(qualifier), 'asia')")
add("p6_unresolved", lambda v: v.edges.where(F.col("dst").contains("::") & ~F.col("dst").contains("#")), "SELECT src, dst, kind FROM v_edges WHERE contains(dst, '::') AND NOT contains(dst, '#')")
add("p7_edges_to", lambda v: v.edges.where("dst = 'class#000000003'"), "SELECT src, dst, kind FROM v_edges WHERE dst = 'class#000000003'")
add("p7_references_for", lambda v: v.refs.where("symbol_id = 'function#000000007'"), "SELECT * FROM v_refs WHERE symbol_id = 'function#000000007'")
add("p8_binding", lambda v: joins.first_of(v.bindings, ["file", "source_file", "original_name"], [F.col("local_name")], ["local_name", "import_text"]), "SELECT file, source_file, original_name, min(local_name) AS local_name, arg_min(import_text, local_name) AS import_text FROM v_bindings GROUP BY 1, 2, 3")
add("p9_by_ids", lambda v: _symbols(v.symbols.join(v.refs.select(F.col("symbol_id").alias("id")).distinct(), "id", "left_semi")), f"SELECT {SYMBOL} FROM v_symbols WHERE id IN (SELECT symbol_id FROM v_refs)")
add("p10_hashes_in_files", lambda v: v.symbols.where("file like '/ws/parts/%' and content_hash is not null").select("content_hash").distinct(), "SELECT DISTINCT content_hash FROM v_symbols WHERE file LIKE '/ws/parts/%' AND content_hash IS NOT NULL")
add("p12_records", lambda v: v.symbols.select("id", F.concat_ws(":", F.regexp_replace("file", "^/ws/", ""), F.col("start_pos").cast("string")).alias("location"), T.is_test_file(F.col("file")).alias("in_tests")), "SELECT id, regexp_replace(file, '^/ws/', '') || ':' || CAST(start_pos AS VARCHAR) AS location, regexp_matches(lower(file), '/(tests|__tests__|test|spec)/') OR regexp_matches(lower(file), '(\\.test\\.(ts|tsx|js|jsx)|\\.spec\\.(ts|tsx|js|jsx)|_test\\.rs|_test\\.go|_spec\\.rb)$') AS in_tests FROM v_symbols")

# joins
add("j2_neighbors", lambda v: graph.neighbors(v.edges, v.symbols, v.symbols.where("kind = 'namespace'").select("id"), ("extends",), True).select("id", "name"), "SELECT DISTINCT s.id, s.name FROM v_edges e JOIN v_symbols s ON s.id = e.src WHERE e.kind = 'extends' AND e.dst LIKE 'namespace#%'")
add("j3_definition", lambda v: joins.definitions(v.refs, v.symbols).select("ref_id", "symbol_id", "def_name", "def_file", "def_start"), "SELECT ref_id, symbol_id, s.name AS def_name, s.file AS def_file, s.start_pos AS def_start FROM v_refs r LEFT JOIN v_symbols s ON s.id = r.symbol_id")
add("j4_narrowest", lambda v: joins.narrowest(v.refs.select(F.col("ref_id").alias("probe_id"), "file", F.col("start_pos").alias("offset")), v.symbols), "SELECT probe_id, id, width FROM (SELECT ref_id AS probe_id, s.id, s.end_pos - s.start_pos AS width, row_number() OVER (PARTITION BY ref_id ORDER BY s.end_pos - s.start_pos, s.start_pos, s.id) AS k FROM v_refs r JOIN v_symbols s ON s.file = r.file AND s.start_pos <= r.start_pos AND r.start_pos < s.end_pos) WHERE k = 1")
add("j5_minus_definition", lambda v: joins.outside_definition(v.refs, v.symbols).select("ref_id", "file", "start_pos"), "SELECT ref_id, r.file, r.start_pos FROM v_refs r LEFT JOIN v_symbols s ON s.id = r.symbol_id WHERE NOT coalesce(r.file = s.file AND r.start_pos >= s.start_pos AND r.end_pos <= s.end_pos, false)")


def _import_via(v: Views) -> DataFrame:
    d = joins.definitions(v.refs, v.symbols).where("file <> def_file")
    b = v.bindings.select("file", F.col("source_file").alias("def_file"), F.col("original_name").alias("def_name"), "import_text")
    return d.join(b, ["file", "def_file", "def_name"], "left").select("ref_id", "file", "import_text")


add("j6_import_via", _import_via, "SELECT ref_id, r.file, b.import_text FROM v_refs r JOIN v_symbols s ON s.id = r.symbol_id AND r.file <> s.file LEFT JOIN v_bindings b ON b.file = r.file AND b.source_file = s.file AND b.original_name = s.name")
add("j8_resolve_edges", lambda v: joins.resolved(v.edges.where(F.col("dst").contains("::") & ~F.col("dst").contains("#")), "src", F.array("dst", F.concat(F.lit("tpch::"), "dst")), v.symbols.select(F.concat_ws("::", "qualifier", "name").alias("key"), "id").groupBy("key").agg(F.min("id").alias("id")), "key", "id", "dst"), "SELECT e.src, coalesce(a.id, b.id, e.dst) AS resolved FROM (SELECT DISTINCT src, dst FROM v_edges WHERE contains(dst, '::') AND NOT contains(dst, '#')) e LEFT JOIN (SELECT qualifier || '::' || name AS k, min(id) AS id FROM v_symbols GROUP BY 1) a ON a.k = e.dst LEFT JOIN (SELECT qualifier || '::' || name AS k, min(id) AS id FROM v_symbols GROUP BY 1) b ON b.k = 'tpch::' || e.dst")
add("j7_resolve_refs", lambda v: joins.resolved(v.bindings.select(F.concat_ws("|", "file", "local_name").alias("ref"), F.concat_ws("|", F.lit("x"), "original_name").alias("missing"), F.concat_ws("|", "source_file", "original_name").alias("one"), F.concat_ws("|", T.strip_extension(F.col("source_file")), "original_name").alias("two")).groupBy("ref", "missing").agg(F.min("one").alias("one"), F.min("two").alias("two")), "ref", F.array("two", "one"), v.symbols.select(F.concat_ws("|", "file", "name").alias("key"), "id").groupBy("key").agg(F.min("id").alias("id")), "key", "id", "missing"), "SELECT b.file || '|' || b.local_name AS ref, min(coalesce(s.id, 'x|' || b.original_name)) AS resolved FROM v_bindings b LEFT JOIN v_symbols s ON s.file = b.source_file AND s.name = b.original_name GROUP BY 1")
add("j9_implementations", lambda v: joins.implementations(v.edges, v.symbols, v.symbols.where("kind in ('class', 'const')"), v.deps), """WITH t AS (SELECT id AS target_id, name, file FROM v_symbols WHERE kind IN ('class', 'const')),
  one AS (SELECT DISTINCT t.target_id, e.src AS id FROM t JOIN v_edges e ON e.dst = t.target_id JOIN v_symbols s ON s.id = e.src),
  same AS (SELECT t.target_id, s.id, t.file = s.file OR EXISTS (SELECT 1 FROM v_deps d WHERE d.to_file = t.file AND d.from_file = s.file) AS near FROM t JOIN v_symbols s ON s.name = t.name AND s.id <> t.target_id),
  a AS (SELECT target_id, id, 1 AS tier FROM one UNION ALL SELECT target_id, id, 2 FROM same WHERE near UNION ALL SELECT target_id, id, 3 FROM same)
  SELECT DISTINCT target_id, id, tier FROM a WHERE id <> target_id AND tier = (SELECT min(tier) FROM a b WHERE b.target_id = a.target_id)""")
add("j11_name_scan", lambda v: joins.name_positions(v.table("documents").select(F.col("doc_id").alias("file"), F.col("text").alias("content")), "the").groupBy("file").agg(F.count("*").alias("n")), "SELECT * FROM (SELECT doc_id AS file, CAST(len(list_filter(regexp_split_to_array(text, '[^A-Za-z0-9_]+'), lambda x: x = 'the')) AS BIGINT) AS n FROM documents) WHERE n > 0")
add("j12_semi", lambda v: stats.duplicate_groups(v.symbols, files=v.symbols.where("is_test").select("file").distinct()), "SELECT s.content_hash, n, s.id FROM v_symbols s JOIN (SELECT content_hash, count(*) AS n FROM v_symbols WHERE content_hash IS NOT NULL AND file IN (SELECT file FROM v_symbols WHERE is_test) GROUP BY 1 HAVING count(*) >= 2) g ON g.content_hash = s.content_hash")
add("j13_prune", lambda v: maintenance.pruned(v.symbols.select(F.col("file").alias("path")).distinct(), v.refs.select(F.col("file").alias("path"))), "SELECT DISTINCT file AS path FROM v_symbols WHERE file NOT IN (SELECT file FROM v_refs)")
add("j15_methods_of_types", lambda v: v.symbols.where("kind = 'class'").join(v.symbols.where("kind = 'method'").groupBy(F.col("container").alias("name")).agg(F.count("*").alias("methods")), "name", "left").select("id", F.coalesce("methods", F.lit(0)).alias("methods")), "SELECT c.id, count(m.id) AS methods FROM v_symbols c LEFT JOIN v_symbols m ON m.kind = 'method' AND m.container = c.name WHERE c.kind = 'class' GROUP BY 1")
add("j17_answered", lambda v: v.table("documents").select("doc_id", F.exists(F.array(F.lit("src/License.md"), F.lit("x/token.ts")), lambda f: F.contains(F.lower("text"), F.lower(f)) | F.contains(F.lower("text"), F.regexp_extract(F.lower(f), r"([^/.]+)\.[^/]*$", 1))).alias("success")), "SELECT doc_id, contains(lower(text), 'license') OR contains(lower(text), 'token') AS success FROM documents")
add("j18_tool_compare", lambda v: v.runs.where("condition = 'control'").groupBy("tool").agg(F.count("*").alias("a")).join(v.runs.where("condition = 'treatment' and wall_time > 50").groupBy("tool").agg(F.count("*").alias("b")), "tool", "full").select("tool", F.coalesce("a", F.lit(0)).alias("control"), F.coalesce("b", F.lit(0)).alias("treatment")), "SELECT tool, count(*) FILTER (condition = 'control') AS control, count(*) FILTER (condition = 'treatment' AND wall_time > 50) AS treatment FROM v_runs GROUP BY 1")

# graph
_START = "function#000000001"


def _closure(name: str, kinds: tuple[str, ...], inbound: bool, start: str) -> None:
    a, b = ("dst", "src") if inbound else ("src", "dst")
    ks = ", ".join(f"'{k}'" for k in kinds)
    add(name, lambda v: graph.hierarchy(v.edges, v.symbols, v.symbols.where(F.col("id") == start).select("id"), kinds, inbound).select("id"), f"RECURSIVE WITH r(id) AS (SELECT DISTINCT e.{b} FROM v_edges e JOIN v_symbols s ON s.id = e.{b} WHERE e.kind IN ({ks}) AND e.{a} = '{start}' UNION SELECT e.{b} FROM r JOIN v_edges e ON e.{a} = r.id JOIN v_symbols s ON s.id = e.{b} WHERE e.kind IN ({ks})) SELECT id FROM r WHERE id <> '{start}'")


add("g1_direct_types", lambda v: graph.neighbors(v.edges, v.symbols, v.symbols.where("kind = 'method'").select("id"), ("implements", "extends", "trait_impl")).select("id"), "SELECT DISTINCT e.dst AS id FROM v_edges e JOIN v_symbols s ON s.id = e.dst WHERE e.kind IN ('implements', 'extends', 'trait_impl') AND e.src LIKE 'method#%'")
_closure("g2_supertypes", ("implements", "extends", "trait_impl"), False, "method#000000001")
_closure("g3_subtypes", ("implements", "extends", "trait_impl"), True, "namespace#000000001")
add("g4_callers", lambda v: graph.neighbors(v.edges, v.symbols, v.symbols.where(F.col("id") == _START).select("id"), ("calls",), True).select("id"), f"SELECT DISTINCT e.src AS id FROM v_edges e JOIN v_symbols s ON s.id = e.src WHERE e.kind = 'calls' AND e.dst = '{_START}'")
_closure("g5_callers_all", ("calls",), True, _START)
_closure("g6_callees_all", ("calls",), False, _START)


def _levels(files: str, links: str, deepest: int = 12) -> str:
    """Levels by longest paths; a path longer than ``deepest`` runs in a cycle or behind one."""
    return f"""e AS (SELECT DISTINCT from_file, to_file FROM {links} WHERE from_file <> to_file AND from_file IN (SELECT file FROM {files}) AND to_file IN (SELECT file FROM {files})),
  l(file, level) AS (SELECT file, 0 FROM {files} UNION SELECT e.from_file, l.level + 1 FROM l JOIN e ON e.to_file = l.file WHERE l.level < {deepest})
  SELECT file, CAST(CASE WHEN max(level) >= {deepest} THEN -1 ELSE max(level) END AS INTEGER) AS level FROM l GROUP BY 1"""


add("g7_invalidation", lambda v: graph.invalidation_order(v.deps, v.spark.createDataFrame([("nation/3",)], "node string")), f"RECURSIVE WITH r(file) AS (SELECT 'nation/3' UNION SELECT d.from_file FROM r JOIN v_deps d ON d.to_file = r.file), {_levels('r', 'v_deps')}")
add("g8_forward", lambda v: graph.dependencies(v.deps, v.spark.createDataFrame([("part/5",)], "node string")).select(F.col("node").alias("file")), "RECURSIVE WITH r(file) AS (SELECT to_file FROM v_deps WHERE from_file = 'part/5' UNION SELECT d.to_file FROM r JOIN v_deps d ON d.from_file = r.file) SELECT file FROM r")
add("g9_batch", lambda v: graph.invalidation_order(v.deps, v.deps.where("to_file in ('region/1', 'region/2')").select(F.col("from_file").alias("node"))), f"RECURSIVE WITH r(file) AS (SELECT from_file FROM v_deps WHERE to_file IN ('region/1', 'region/2') UNION SELECT d.from_file FROM r JOIN v_deps d ON d.to_file = r.file), {_levels('r', 'v_deps')}")
_CYCLE = "SELECT 'nation/' || CAST(n_nationkey AS VARCHAR(20)) AS from_file, 'nation/' || CAST((n_nationkey + 1) % 3 AS VARCHAR(20)) AS to_file FROM {nation} WHERE n_nationkey < 3"


def _with_cycle(v: Views) -> DataFrame:
    return v.deps.select("from_file", "to_file").union(v.spark.sql(_CYCLE, nation=v.table("nation")))


def _nodes(deps: DataFrame) -> DataFrame:
    return deps.select(F.col("from_file").alias("file")).union(deps.select("to_file"))


_FILES = "f AS (SELECT from_file AS file FROM x UNION SELECT to_file FROM x)"
add("g10_topo_levels", lambda v: graph.topological_levels(v.deps, _nodes(v.deps)), f"RECURSIVE WITH x AS (SELECT from_file, to_file FROM v_deps), {_FILES}, {_levels('f', 'x')}")
add("g10_topo_levels_cycle", lambda v: graph.topological_levels(_with_cycle(v), _nodes(_with_cycle(v))), f"RECURSIVE WITH x AS (SELECT from_file, to_file FROM v_deps UNION ALL {_CYCLE.format(nation='nation')}), {_FILES}, {_levels('f', 'x')}")
add("g12_includers", lambda v: v.deps.where("to_file = 'nation/3'").select(F.col("from_file").alias("file")).distinct(), "SELECT DISTINCT from_file AS file FROM v_deps WHERE to_file = 'nation/3'")
add("g13_outline", lambda v: stats.outline(v.symbols.withColumn("file", F.lit("all"))).select("id", "depth"), "WITH p AS (SELECT name, arg_min(id, start_pos * 1000000 + row_number) AS pid FROM (SELECT *, row_number() OVER (ORDER BY id) AS row_number FROM v_symbols) GROUP BY name), c AS (SELECT s.id, CASE WHEN p.pid <> s.id THEN p.pid END AS parent FROM v_symbols s LEFT JOIN p ON p.name = s.container) SELECT a.id, CAST(CASE WHEN a.parent IS NULL THEN 0 WHEN b.parent IS NULL THEN 1 ELSE 2 END AS INTEGER) AS depth FROM c a LEFT JOIN c b ON b.id = a.parent")
add("g14_previous_calls", lambda v: v.calls.select("call_id", F.reverse(F.collect_list("tool_name").over(W.partitionBy("session_id").orderBy("ts", "call_id").rowsBetween(-3, -1))).alias("t")).select("call_id", F.array_join("t", ",").alias("previous")), "SELECT call_id, concat_ws(',', lag(tool_name, 1) OVER w, lag(tool_name, 2) OVER w, lag(tool_name, 3) OVER w) AS previous FROM v_calls WINDOW w AS (PARTITION BY session_id ORDER BY ts, call_id)")

# aggregates
add("a1_by_kind", lambda v: v.symbols.groupBy("kind").agg(F.count("*").alias("n")), "SELECT kind, count(*) AS n FROM v_symbols GROUP BY 1")
add("a2_by_language", lambda v: v.symbols.select("file").distinct().groupBy(T.language(F.col("file")).alias("language")).agg(F.count("*").alias("n")), "SELECT CASE regexp_extract(file, '\\.([^./]*)$', 1) WHEN 'rs' THEN 'rust' WHEN 'ts' THEN 'typescript' WHEN 'py' THEN 'python' WHEN 'go' THEN 'go' WHEN 'kt' THEN 'kotlin' ELSE 'other' END AS language, count(DISTINCT file) AS n FROM v_symbols GROUP BY 1")
add("a3_last_updated", lambda v: v.table("events").agg(F.date_format(F.max("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("last")), "SELECT strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS last FROM events")
add("a5_file_stats", lambda v: stats.file_stats(v.symbols), "SELECT file, count(*) AS symbols, count(*) FILTER (kind = 'function') AS functions, count(*) FILTER (kind = 'class') AS classes, count(*) FILTER (kind = 'interface') AS interfaces FROM v_symbols GROUP BY 1")
add("a6_totals", lambda v: stats.file_stats(v.symbols).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("symbols", "functions", "classes", "interfaces")]), "SELECT count(*) AS symbols, count(*) FILTER (kind = 'function') AS functions, count(*) FILTER (kind = 'class') AS classes, count(*) FILTER (kind = 'interface') AS interfaces FROM v_symbols")
_PLAIN = "trim(regexp_replace(text, '[ \\t\\n\\f\\r]+', ' ', 'g'))"
add("a7_duplicates", lambda v: stats.duplicate_groups(v.table("documents").select(F.col("doc_id").alias("id"), T.content_hash(F.col("text")).alias("content_hash"))), f"SELECT content_hash, n, id FROM (SELECT doc_id AS id, content_hash, count(*) OVER (PARTITION BY content_hash) AS n FROM (SELECT doc_id, left(sha256({_PLAIN}), 16) AS content_hash FROM documents WHERE strlen(text) >= 50 AND strlen({_PLAIN}) >= 50)) WHERE n >= 2")
add("a7_duplicates_of_kind", lambda v: stats.duplicate_groups(v.symbols, 3, "method"), "SELECT s.content_hash, n, s.id FROM v_symbols s JOIN (SELECT content_hash, count(*) AS n FROM v_symbols WHERE kind = 'method' GROUP BY 1 HAVING count(*) >= 3) g ON g.content_hash = s.content_hash")
add("a8_edge_counts", lambda v: stats.edge_multiplicity(v.edges, v.table("lineitem").count()).where("n > 1"), "SELECT src, dst, kind, count(*) AS n FROM v_edges GROUP BY 1, 2, 3 HAVING count(*) > 1")
add("a9_key_types", lambda v: stats.key_types(v.symbols.withColumn("file", F.lit("all"))).select("name", "methods", "rank"), "SELECT name, methods, CAST(rank AS INTEGER) AS rank FROM (SELECT c.name, methods, row_number() OVER (ORDER BY methods DESC, c.name) AS rank FROM (SELECT DISTINCT name FROM v_symbols WHERE kind = 'class') c JOIN (SELECT container AS name, count(*) AS methods FROM v_symbols WHERE kind IN ('method', 'function') GROUP BY 1 HAVING count(*) >= 3) m ON m.name = c.name) WHERE rank <= 5")
add("a10_usage_summary", lambda v: v.refs.agg(F.count("*").alias("total"), F.count_distinct("file").alias("files"), F.count_if(~T.is_test_file(F.col("file"))).alias("prod"), F.count_if(T.is_test_file(F.col("file"))).alias("test")), "SELECT count(*) AS total, count(DISTINCT file) AS files, count(*) FILTER (NOT file LIKE '%_test.go') AS prod, count(*) FILTER (file LIKE '%_test.go') AS test FROM v_refs")
add("a11_first_by_name", lambda v: joins.first_of(v.symbols, ["file", "container"], [F.col("start_pos"), F.col("id")], ["id"]), "SELECT file, container, arg_min(id, lpad(CAST(start_pos AS VARCHAR), 12, '0') || id) AS id FROM v_symbols GROUP BY 1, 2")
add("a12_tool_distribution", lambda v: C.distribution(v.calls, ["session_id", "tool_name"]), "SELECT session_id, tool_name, count(*) AS calls, CAST(sum(result_tokens) AS BIGINT) AS tokens FROM v_calls GROUP BY 1, 2")
add("a13_all_sessions", lambda v: C.distribution(v.calls, ["tool_name"]), "SELECT tool_name, count(*) AS calls, CAST(sum(result_tokens) AS BIGINT) AS tokens FROM v_calls GROUP BY 1")
add("a14_savings_by_tool", lambda v: v.calls.groupBy("tool_name").agg(F.count("*").alias("n"), F.sum("result_tokens").cast("long").alias("saved")).join(F.broadcast(v.spark.createDataFrame([("Grep", 1), ("Read", 2), ("Glob", 3)], "tool_name string, priority int")), "tool_name"), "SELECT tool_name, count(*) AS n, CAST(sum(result_tokens) AS BIGINT) AS saved, CAST(CASE tool_name WHEN 'Grep' THEN 1 WHEN 'Read' THEN 2 ELSE 3 END AS INTEGER) AS priority FROM v_calls WHERE tool_name IN ('Grep', 'Read', 'Glob') GROUP BY 1")
_STATS = "round(avg({v}), 2) AS mean, round(coalesce(stddev_samp({v}), 0), 2) AS std, round(min({v}), 2) AS min, round(max({v}), 2) AS max"
add("a15_run_stats", lambda v: v.runs.groupBy("task_id", "condition").agg(*stats.sample_stats("wall_time")), f"SELECT task_id, condition, {_STATS.format(v='wall_time')} FROM v_runs GROUP BY 1, 2")


def _zero_fill(v: Views) -> DataFrame:
    # tasks without a tool count as 0: sums over the others and the number of tasks are enough
    tasks = v.runs.select("task_id").distinct().count()
    n = v.runs.groupBy("task_id", "tool").agg(F.count("*").cast("double").alias("n"))
    return stats.zero_filled_stats(n, "tool", "n", tasks)


add("a16_zero_fill", _zero_fill, f"SELECT tool, {_STATS.format(v='n')} FROM (SELECT t.task_id, o.tool, CAST(count(r.tool) AS DOUBLE) AS n FROM (SELECT DISTINCT task_id FROM v_runs) t CROSS JOIN (SELECT DISTINCT tool FROM v_runs) o LEFT JOIN v_runs r ON r.task_id = t.task_id AND r.tool = o.tool GROUP BY 1, 2) GROUP BY 1")
add("a17_suite", lambda v: v.runs.agg(*[F.sum(F.when(F.col("condition") == c, F.col("tokens_in"))).cast("long").alias(c) for c in ("control", "treatment")]).select("control", "treatment", F.round((F.col("control") - F.col("treatment")) / F.greatest(F.lit(1), F.col("control")) * 100, 4).alias("savings_pct")), "SELECT control, treatment, round((control - treatment) / greatest(1, control) * 100, 4) AS savings_pct FROM (SELECT CAST(sum(tokens_in) FILTER (condition = 'control') AS BIGINT) AS control, CAST(sum(tokens_in) FILTER (condition = 'treatment') AS BIGINT) AS treatment FROM v_runs)")
add("a18_speedup", lambda v: v.runs.groupBy("task_id").agg(F.round(F.avg(F.when(F.col("wall_time") > 20, F.col("wall_time"))), 4).alias("speed"), F.round(F.avg(F.col("success").cast("double")), 6).alias("recall")), "SELECT task_id, round(avg(wall_time) FILTER (wall_time > 20), 4) AS speed, round(avg(CAST(success AS DOUBLE)), 6) AS recall FROM v_runs GROUP BY 1")
add("a19_branch", lambda v: v.runs.groupBy("condition").agg(F.count("*").alias("runs"), F.round(F.avg(F.col("tokens_in") + F.col("tokens_out")), 2).alias("tokens"), F.count_if("success").alias("ok")), "SELECT condition, count(*) AS runs, round(avg(tokens_in + tokens_out), 2) AS tokens, count(*) FILTER (success) AS ok FROM v_runs GROUP BY 1")
_BUCKET = "CASE WHEN wall_time < 15 THEN '<15' WHEN wall_time < 30 THEN '15-30' WHEN wall_time < 60 THEN '30-60' WHEN wall_time <= 120 THEN '60-120' ELSE '>120' END"
add("a20_buckets", lambda v: v.runs.groupBy("condition", F.expr(_BUCKET).alias("bucket")).agg(F.count("*").alias("n")), f"SELECT condition, {_BUCKET} AS bucket, count(*) AS n FROM v_runs GROUP BY 1, 2")
add("a20_quartiles", lambda v: v.runs.groupBy("condition").agg(F.percentile("wall_time", F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias("q")).select("condition", *[F.round(F.get("q", F.lit(k)), 6).alias(f"q{k + 1}") for k in range(3)]), "SELECT condition, round(quantile_cont(wall_time, 0.25), 6) AS q1, round(quantile_cont(wall_time, 0.5), 6) AS q2, round(quantile_cont(wall_time, 0.75), 6) AS q3 FROM v_runs GROUP BY 1")
add("a21_attribution", lambda v: v.table("conversations").groupBy("role").agg(F.sum(F.floor(F.length("text") / 4)).cast("long").alias("tokens")), "SELECT role, CAST(sum(floor(length(text) / 4)) AS BIGINT) AS tokens FROM conversations GROUP BY 1")


# statistics
def _welch(v: Views) -> DataFrame:
    t = v.runs.groupBy("task_id").agg(*[f for c in ("control", "treatment") for w in [F.when(F.col("condition") == c, F.col("wall_time"))] for f in (F.avg(w).alias(c[0] + "m"), F.stddev_samp(w).alias(c[0] + "s"), F.count(w).alias(c[0] + "n"))]).where("cn > 1 and tn > 1")
    out = stats.welch(*[F.col(x) for x in ("cm", "cs", "cn", "tm", "ts", "tn")])
    return t.select("task_id", *[(F.round(c, 6) if k not in ("effect", "stars") else c).alias(k) for k, c in out.items()])


add("b1_welch", _welch, """WITH a AS (SELECT task_id, avg(wall_time) FILTER (condition = 'control') AS m1, stddev_samp(wall_time) FILTER (condition = 'control') AS s1, count(*) FILTER (condition = 'control') AS n1,
  avg(wall_time) FILTER (condition = 'treatment') AS m2, stddev_samp(wall_time) FILTER (condition = 'treatment') AS s2, count(*) FILTER (condition = 'treatment') AS n2 FROM v_runs GROUP BY 1),
  b AS (SELECT task_id, m1 - m2 AS diff, s1 * s1 / n1 AS v1, s2 * s2 / n2 AS v2, n1, n2, sqrt((s1 * s1 + s2 * s2) / 2) AS pooled FROM a WHERE n1 > 1 AND n2 > 1),
  c AS (SELECT task_id, diff, diff / sqrt(v1 + v2) AS t, (v1 + v2) * (v1 + v2) / (v1 * v1 / (n1 - 1) + v2 * v2 / (n2 - 1)) AS df, sqrt(v1 + v2) AS se, diff / pooled AS d FROM b)
  SELECT task_id, round(diff, 6) AS diff, round(t, 6) AS t, round(df, 6) AS df, round(diff - CASE WHEN df > 30 THEN 2.0 ELSE 2.1 END * se, 6) AS low, round(diff + CASE WHEN df > 30 THEN 2.0 ELSE 2.1 END * se, 6) AS high, round(d, 6) AS d,
  CASE WHEN abs(d) >= 1 THEN 'very large' WHEN abs(d) >= 0.8 THEN 'large' WHEN abs(d) >= 0.5 THEN 'medium' WHEN abs(d) >= 0.2 THEN 'small' ELSE 'negligible' END AS effect, CASE WHEN abs(t) > 4 THEN '***' WHEN abs(t) > 3 THEN '**' WHEN abs(t) > 2 THEN '*' ELSE '' END AS stars FROM c""")
add("b5_stars", lambda v: v.runs.select("event_id", stats.stars_by_p(F.col("wall_time") / 1000).alias("by_p"), stats.stars_by_t(F.col("wall_time") / 10).alias("by_t")), "SELECT event_id, CASE WHEN wall_time / 1000 < 0.001 THEN '***' WHEN wall_time / 1000 < 0.01 THEN '**' WHEN wall_time / 1000 < 0.05 THEN '*' ELSE '' END AS by_p, CASE WHEN abs(wall_time / 10) > 4 THEN '***' WHEN abs(wall_time / 10) > 3 THEN '**' WHEN abs(wall_time / 10) > 2 THEN '*' ELSE '' END AS by_t FROM v_runs")
add("b7_mann_whitney_u", lambda v: stats.mann_whitney(v.runs, "condition", "control", "treatment", "tokens_out").select("n1", "n2", F.round("u", 3).alias("u"), F.round("z", 6).alias("z")), "WITH r AS (SELECT condition, rank() OVER (ORDER BY tokens_out) + (count(*) OVER (PARTITION BY tokens_out) - 1) / 2.0 AS k, count(*) OVER (PARTITION BY tokens_out) AS c FROM v_runs), s AS (SELECT sum(k) FILTER (condition = 'control') AS r1, CAST(count(*) FILTER (condition = 'control') AS BIGINT) AS n1, CAST(count(*) FILTER (condition = 'treatment') AS BIGINT) AS n2, sum(CAST(c AS DOUBLE) * c - 1) AS ties FROM r), u AS (SELECT n1, n2, r1 - n1 * (n1 + 1) / 2.0 AS u, ties FROM s) SELECT n1, n2, round(u, 3) AS u, round((abs(u - n1 * n2 / 2.0) - 0.5) / sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - ties / (CAST(n1 + n2 AS DOUBLE) * (n1 + n2 - 1)))), 6) AS z FROM u")
add("b8_delta", lambda v: v.runs.groupBy("task_id").agg(F.sum(F.when(F.col("condition") == "control", F.col("tokens_in")).otherwise(0)).cast("double").alias("a"), F.sum(F.when(F.col("condition") == "treatment", F.col("tokens_in")).otherwise(0)).cast("double").alias("b")).select("task_id", *[F.round(c, 4).alias(n) for c, n in zip(stats.change(F.col("a"), F.col("b")), ("delta", "pct"), strict=True)]), "SELECT task_id, round(b - a, 4) AS delta, round(CASE WHEN a = 0 THEN 0.0 ELSE (b - a) / a * 100 END, 4) AS pct FROM (SELECT task_id, CAST(sum(CASE WHEN condition = 'control' THEN tokens_in ELSE 0 END) AS DOUBLE) AS a, CAST(sum(CASE WHEN condition = 'treatment' THEN tokens_in ELSE 0 END) AS DOUBLE) AS b FROM v_runs GROUP BY 1)")
add("b10_cost", lambda v: v.runs.select("event_id", F.round(stats.cost(F.col("tokens_in"), F.col("tokens_out"), F.lit(100), F.lit(7)), 8).alias("cost")), "SELECT event_id, round((3.0 * tokens_in + 15.0 * tokens_out + 0.30 * 100 + 3.75 * 7)::DOUBLE / 1000000, 8) AS cost FROM v_runs")

# sequences
_TURN = "sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
add("w5_turns", lambda v: C.turns(v.table("conversations"), "conv_id", ["turn"]).select("conv_id", "turn", "turn_no"), f"SELECT conv_id, turn, CAST({_TURN} AS BIGINT) AS turn_no FROM conversations")
add("w2_context_tokens", lambda v: C.context_tokens(v.calls.withColumn("task", F.lit(100)).withColumn("out", F.lit(5)), "session_id", "call_id", "task", "out", "result_tokens").select("call_id", "context_tokens"), "SELECT call_id, CAST(100 + coalesce(sum(5 + result_tokens) OVER (PARTITION BY session_id ORDER BY call_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS context_tokens FROM v_calls")


#: The patterns of v_calls that look like names in code.
_NAMES = "('getUserName', 'user_id')"


def _after(now: str, before: str, back: int, typical: int, test: str) -> str:
    return f"""WITH c AS (SELECT *, last_value(CASE WHEN tool_name = '{before}' THEN call_id END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY ts, call_id ROWS BETWEEN {back} PRECEDING AND 1 PRECEDING) AS g FROM v_calls),
  d AS (SELECT c.call_id, CAST(greatest(0, g.result_tokens + c.result_tokens - {typical}) AS BIGINT) AS saved FROM c JOIN v_calls g ON g.call_id = c.g WHERE c.tool_name = '{now}' AND {test})
  SELECT call_id, saved, CASE WHEN saved > 500 THEN 0.85 ELSE 0.75 END::DOUBLE AS confidence FROM d WHERE saved >= 100"""


add("w3_multi_hop", lambda v: C.multi_hop(v.calls, "session_id", ["ts", "call_id"]).select("call_id", "saved", "confidence"), _after("Read", "Grep", 5, 150, f"g.pattern IN {_NAMES} AND contains(g.result, regexp_extract(c.file_path, '[^/]+$'))"))
add("w4_find_grep", lambda v: C.find_then_grep(v.calls, "session_id", ["ts", "call_id"]).select("call_id", "saved", "confidence"), _after("Grep", "Glob", 3, 300, f"c.pattern IN {_NAMES}"))
_SEARCHED = "CASE p_partkey % 4 WHEN 0 THEN 'def ' || lower(p_brand) WHEN 1 THEN 'getUserName' WHEN 2 THEN 'two words' ELSE 'user_id' END"
add(
    "r1_grep_rule",
    lambda v: v.table("part").select("p_partkey", C.grep_rule(F.expr(_SEARCHED), F.col("p_size") > 25, F.col("p_retailprice")).alias("r")).select("p_partkey", "r.tool", "r.confidence"),
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'symbols' WHEN 2 THEN NULL ELSE CASE WHEN p_size > 25 THEN 'usages' ELSE 'symbol' END END AS tool,
  CASE WHEN p_partkey % 4 <> 2 THEN round((CASE WHEN p_partkey % 4 = 0 THEN 0.75 WHEN p_size > 25 THEN 0.85 ELSE 0.70 END + CASE WHEN p_retailprice > 500 THEN 0.1 ELSE 0 END)::DOUBLE, 2) END AS confidence FROM part""",
)
add("r2_grep_tool", lambda v: v.calls.where("tool_name = 'Grep'").select("call_id", C.grep_tool_rule(F.col("result_tokens"), F.col("pattern")).alias("confidence")), f"SELECT call_id, CASE WHEN pattern IN {_NAMES} THEN CASE WHEN result_tokens > 500 THEN 0.9 ELSE 0.8 END END::DOUBLE AS confidence FROM v_calls WHERE tool_name = 'Grep'")
add("r3_read_rule", lambda v: v.calls.where("tool_name = 'Read'").select("call_id", C.read_rule(F.concat(F.lit("a."), F.when(F.col("call_id") % 2 == 0, "py").otherwise("md")), F.col("result_tokens"), F.lit(False)).alias("r")).where("r is not null").select("call_id", "r.saved", "r.confidence"), "SELECT call_id, CAST(greatest(0, result_tokens - (200 + floor(result_tokens * 0.3))) AS BIGINT) AS saved, CASE WHEN result_tokens > 2000 THEN 0.9 WHEN result_tokens > 1000 THEN 0.8 ELSE 0.7 END::DOUBLE AS confidence FROM v_calls WHERE tool_name = 'Read' AND call_id % 2 = 0 AND result_tokens >= 500")
add("r4_find_exec", lambda v: v.calls.select("call_id", C.find_exec_rule(F.col("result_tokens"), F.col("pattern")).alias("r")).where("r is not null").select("call_id", "r.saved", "r.confidence"), f"SELECT call_id, CAST(result_tokens - 300 AS BIGINT) AS saved, CASE WHEN result_tokens - 300 > 300 THEN 0.8 ELSE 0.7 END::DOUBLE AS confidence FROM v_calls WHERE result_tokens - 300 >= 50 AND pattern IN {_NAMES}")
add("j16_tool_results", lambda v: v.calls.where("tool_name = 'Grep'").select("session_id", "call_id").join(v.calls.where("tool_name = 'Read'").groupBy("session_id").agg(F.max_by("result_tokens", "call_id").alias("last_read")), "session_id", "left"), "SELECT c.session_id, c.call_id, r.last_read FROM v_calls c LEFT JOIN (SELECT session_id, arg_max(result_tokens, call_id) AS last_read FROM v_calls WHERE tool_name = 'Read' GROUP BY 1) r ON r.session_id = c.session_id WHERE c.tool_name = 'Grep'")


def _commands(v: Views) -> DataFrame:
    k, lit = F.col("call_id") % 6, F.lit
    one = F.when(k == 0, F.concat(lit("grep -rn 'x"), "call_id", lit(" y' src/"))).when(k == 1, lit('find lib -name "*.py" -type f')).when(k == 2, lit('find . -name "*.ts" -exec grep -l useState {} \\;'))
    return v.calls.select("call_id", one.when(k == 3, lit("/usr/bin/cat -n a.txt")).when(k == 4, lit("ls -R src")).otherwise(lit('grep "open a')).alias("command"))


add(
    "f26_shell_classify",
    lambda v: C.classified(_commands(v)).select("call_id", "info.command_type", "info.pattern", "info.target_path", "info.is_recursive"),
    """SELECT call_id, CASE call_id % 6 WHEN 0 THEN 'grep' WHEN 1 THEN 'find' WHEN 2 THEN 'find' WHEN 3 THEN 'read' WHEN 4 THEN 'list' ELSE 'grep' END AS command_type,
  CASE call_id % 6 WHEN 0 THEN 'x' || CAST(call_id AS VARCHAR) || ' y' WHEN 1 THEN '*.py' WHEN 2 THEN 'useState' WHEN 5 THEN '"open' END AS pattern,
  CASE call_id % 6 WHEN 0 THEN 'src/' WHEN 1 THEN 'lib' WHEN 2 THEN '.' WHEN 3 THEN 'a.txt' WHEN 4 THEN 'src' ELSE 'a' END AS target_path, call_id % 6 IN (0, 1, 2, 4) AS is_recursive FROM v_calls""",
)

# order, paging, sets
add("o1_page", lambda v: _symbols(S.search(v.symbols, S.Query(kind="method", limit=25, offset=10))), f"SELECT {SYMBOL} FROM v_symbols WHERE kind = 'method' ORDER BY id LIMIT 25 OFFSET 10")
add("o2_keyset_page", lambda v: _symbols(v.symbols.where("id > 'const#000000050'").orderBy("id").limit(21)), f"SELECT {SYMBOL} FROM v_symbols WHERE id > 'const#000000050' ORDER BY id LIMIT 21")
add("o3_fts_list", lambda v: S.ranked(S.full_text(v.symbols, "brand#1"), "brand#1").limit(20).select("id", "name"), "SELECT id, name FROM v_symbols WHERE lower(name) LIKE '%brand#1%' OR lower(qualifier) LIKE '%brand#1%' ORDER BY NOT contains(lower(name), 'brand#1'), length(name), id LIMIT 20")
add("o4_candidate", lambda v: joins.first_of(v.symbols, ["kind"], [F.col("file"), F.coalesce("qualifier", F.lit("")), F.col("start_pos")], ["id"]), "SELECT kind, id FROM (SELECT kind, id, row_number() OVER (PARTITION BY kind ORDER BY file, qualifier NULLS FIRST, start_pos) AS k FROM v_symbols) WHERE k = 1")
add("o8_topk", lambda v: v.calls.withColumn("rank", F.row_number().over(W.partitionBy("tool_name").orderBy(F.desc("result_tokens"), "call_id"))).where("rank <= 5").select("tool_name", "call_id", "rank"), "SELECT tool_name, call_id, CAST(rank AS INTEGER) AS rank FROM (SELECT tool_name, call_id, row_number() OVER (PARTITION BY tool_name ORDER BY result_tokens DESC, call_id) AS rank FROM v_calls) WHERE rank <= 5")
add("u1_dedup", lambda v: v.refs.select("file", "start_pos", "end_pos").distinct(), "SELECT DISTINCT file, start_pos, end_pos FROM v_refs")
add("u3_changed_union", lambda v: v.deps.select(F.col("from_file").alias("f")).union(v.deps.select("to_file")).distinct(), "SELECT from_file AS f FROM v_deps UNION SELECT to_file FROM v_deps")
add("u4_difference", lambda v: v.deps.select(F.col("to_file").alias("f")).subtract(v.deps.select("from_file")), "SELECT to_file AS f FROM v_deps EXCEPT SELECT from_file FROM v_deps")
_PATCH = "'diff --git a/src/' || p_brand || '.py b/src/' || p_brand || '.py' || chr(10) || '+++ b/lib/' || CAST(p_size AS VARCHAR(20)) || '.py' || chr(10)"
add("u5_gold_files", lambda v: v.table("part").select("p_partkey", F.array_join(T.gold_files(F.expr(_PATCH)), ",").alias("files")), "SELECT p_partkey, 'lib/' || CAST(p_size AS VARCHAR) || '.py,src/' || p_brand || '.py' AS files FROM part")

# scalar functions
add("f1_slashes", lambda v: v.symbols.select("id", T.normalize_path(F.translate("file", "/", "\\")).alias("path")), "SELECT id, file AS path FROM v_symbols")
add("f2_strip_ext", lambda v: v.table("pages").select("page_id", T.strip_extension(F.concat("url", F.lit(".tar.gz"))).alias("path")), "SELECT page_id, regexp_replace(url || '.tar.gz', '^(.+)\\.[^./]*$', '\\1') AS path FROM pages")
add("f3_normalize_path", lambda v: v.symbols.select("id", T.resolve_dots(F.concat(F.lit("/a/./b/../"), "id", F.lit("//x/.."))).alias("path")), "SELECT id, '/a/' || id AS path FROM v_symbols")
add("f6_last_segment", lambda v: v.symbols.select("id", T.last_segment(F.col("qualifier"), "::").alias("last")), "SELECT id, regexp_replace(qualifier, '^.*::', '') AS last FROM v_symbols")
add("f7_squeeze", lambda v: v.table("documents").select("doc_id", F.md5(T.squeeze(F.col("text"))).alias("h")), f"SELECT doc_id, md5({_PLAIN}) AS h FROM documents")
add("f8_hash", lambda v: v.table("conversations").select("conv_id", "turn", T.content_hash(F.col("text")).alias("h")), f"SELECT conv_id, turn, CASE WHEN strlen(text) >= 50 AND strlen({_PLAIN}) >= 50 THEN left(sha256({_PLAIN}), 16) END AS h FROM conversations")
add("f9_offset_to_linecol", lambda v: v.table("documents").select("doc_id", T.line_and_column(T.line_starts(F.col("text")), F.floor(F.octet_length("text") / 2), F.octet_length("text")).alias("p")).select("doc_id", "p.line", "p.col"), "WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS ls, CAST(floor(strlen(text) / 2) AS BIGINT) AS off FROM documents), e AS (SELECT doc_id, off, unnest(list_prepend(0, [list_sum(list_transform(ls[1:i], lambda x: strlen(x) + 1)) FOR i IN range(1, len(ls))])) AS s FROM t) SELECT doc_id, CAST(count(*) AS BIGINT) AS line, CAST(max(off) - max(s) + 1 AS BIGINT) AS col FROM e WHERE s <= off GROUP BY 1")
add("f10_linecol_to_offset", lambda v: v.table("documents").select("doc_id", T.offset_of(F.col("text"), F.lit(2), F.lit(5)).alias("off")), "SELECT doc_id, CASE WHEN len(string_split(text, chr(10))) >= 2 THEN CAST(strlen(string_split(text, chr(10))[1]) + 1 + least(4, strlen(string_split(text, chr(10))[2])) AS BIGINT) END AS off FROM documents")
add("f11_identifier_at", lambda v: v.table("part").select("p_partkey", T.identifier_at(F.concat(F.lit("let "), F.regexp_replace("p_name", "[^A-Za-z0-9_]", "_"), F.lit(" = 1;")), F.lit(6)).alias("name")), "SELECT p_partkey, regexp_replace(p_name, '[^A-Za-z0-9_]', '_', 'g') AS name FROM part")
add("f14_snippet", lambda v: v.table("part").select("p_partkey", T.snippet(F.col("p_name"), F.lit(1), F.lit(4)).alias("s")), "SELECT p_partkey, substr(p_name, 2, 3) AS s FROM part")
add("f16_is_test", lambda v: v.symbols.select("id", T.is_test_file(F.col("file")).alias("t")), "SELECT id, file LIKE '%/tests/%' OR file LIKE '%\\_test.go' ESCAPE '\\' AS t FROM v_symbols")
add("f18_language", lambda v: v.symbols.select("id", T.language(F.col("file")).alias("language")), "SELECT id, CASE regexp_extract(file, '\\.([^./]*)$', 1) WHEN 'rs' THEN 'rust' WHEN 'ts' THEN 'typescript' WHEN 'py' THEN 'python' WHEN 'go' THEN 'go' WHEN 'kt' THEN 'kotlin' ELSE 'other' END AS language FROM v_symbols")
add("f19_position_arg", lambda v: v.symbols.select("id", T.position_argument(F.concat("file", F.lit(":12:"), "start_pos")).alias("p")).select("id", "p.path", "p.line", "p.col"), "SELECT id, file AS path, CAST(12 AS BIGINT) AS line, start_pos AS col FROM v_symbols")
add("f20_kind_short", lambda v: v.symbols.select("id", T.kind_short(F.col("kind")).alias("k")), "SELECT id, CASE kind WHEN 'function' THEN 'fn' WHEN 'method' THEN 'm' WHEN 'class' THEN 'c' WHEN 'const' THEN 'const' WHEN 'namespace' THEN 'ns' ELSE '??' END AS k FROM v_symbols")
add("f23_tokens", lambda v: v.table("conversations").select("conv_id", "turn", T.estimated_tokens(F.col("text")).alias("n")), "SELECT conv_id, turn, CAST(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, floor(length(text) / 4)) END AS BIGINT) AS n FROM conversations")
add("f27_identifier", lambda v: v.table("part").select("p_partkey", T.identifier_like(F.concat(F.lit("^"), F.regexp_replace("p_name", " ", "_"), F.lit(".*"))).alias("x")), "SELECT p_partkey, regexp_matches(regexp_replace('^' || replace(p_name, ' ', '_') || '.*', '^[\\\\^$.*+?()\\[\\]{}|]+|[\\\\^$.*+?()\\[\\]{}|]+$', '', 'g'), '^[a-z]+[A-Z][A-Za-z0-9]*$|^[A-Z][A-Za-z0-9]+$|^[a-z0-9]+(_[a-z0-9]+)+$|^[A-Z0-9]+(_[A-Z0-9]+)+$|^[a-zA-Z_][a-zA-Z0-9_]{2,}$') AS x FROM part")
add("f31_final_answer", lambda v: v.table("part").select("p_partkey", T.final_answers(F.concat(F.lit("so\nFINAL_ANSWER:  "), "p_brand", F.lit(" \nFINAL_ANSWER: x"))).alias("a")), "SELECT p_partkey, p_brand || chr(10) || 'x' AS a FROM part")
add("f32_branch", lambda v: v.symbols.select("id", T.safe_branch(F.col("qualifier")).alias("b")), "SELECT id, regexp_replace(qualifier, '[^A-Za-z0-9._-]', '-', 'g') AS b FROM v_symbols")

# change feed, maintenance, text tools
add("st2_event_dedup", lambda v: maintenance.latest_changes(v.table("events").select(F.col("user_id").alias("path"), F.col("event_type").alias("op"), F.col("event_id").alias("seq"))), "SELECT user_id AS path, arg_max(event_type, event_id) AS op, max(event_id) AS seq FROM events GROUP BY 1")
add("m1_replace_file", lambda v: maintenance.replaced(v.symbols.select("file", "id"), v.refs.select("file", F.col("symbol_id").alias("id")).distinct()), "SELECT file, id FROM v_symbols WHERE file NOT IN (SELECT file FROM v_refs) UNION ALL SELECT DISTINCT file, symbol_id FROM v_refs")
add("m5_remove_files", lambda v: maintenance.without_files({"dependencies": v.deps}, v.deps.where("to_file like 'region/%'").select(F.col("to_file").alias("path")))["dependencies"], "SELECT from_file, to_file, kind FROM v_deps WHERE to_file NOT LIKE 'region/%'")
add("tx1_grep", lambda v: files.grep(v.table("documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content")), "[Ll]icense", limit=50).select("path", "line_no", "line"), "SELECT path, line_no, line FROM (SELECT doc_id AS path, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS BIGINT) AS line_no FROM documents) WHERE regexp_matches(line, '[Ll]icense') ORDER BY 1, 2 LIMIT 50")
add("tx2_find", lambda v: files.find_files(v.symbols.select(F.col("file").alias("path")).distinct(), "*.go"), "SELECT path FROM (SELECT DISTINCT file AS path FROM v_symbols WHERE file LIKE '%.go') ORDER BY 1 LIMIT 50")
add("tx3_read_range", lambda v: files.read_range(v.table("documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content")), 1, 2), "SELECT doc_id AS path, '    1 ' || string_split(text, chr(10))[1] || CASE WHEN len(string_split(text, chr(10))) > 1 THEN chr(10) || '    2 ' || string_split(text, chr(10))[2] ELSE '' END AS text FROM documents")

from . import code as _code  # noqa: E402, F401
from . import fulltext_queries as _fulltext  # noqa: E402, F401
from . import ordering_queries as _ordering  # noqa: E402, F401
from . import position_queries as _positions  # noqa: E402, F401
from . import rank_queries as _ranks  # noqa: E402, F401
from . import report_queries as _reports  # noqa: E402, F401
from . import resolution_queries as _resolution  # noqa: E402, F401
