"""Registered queries of the output, report, import and comparison operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import imports as I
from ..functions import text as T
from ..operators import graph, joins, maintenance, reports, stats
from ..telemetry import calls as C
from .registry import add
from .views import Views

_TEST = "(is_test OR file LIKE '%/tests/%' OR file LIKE '%\\_test.go' ESCAPE '\\')"
_ROWS = f"""SELECT id, name, kind, CASE WHEN {_TEST} THEN 'test' ELSE 'prod' END AS context, file || ':' || CAST(start_pos AS VARCHAR) AS location, coalesce(visibility, '') AS visibility, coalesce(container, '') AS container FROM v_symbols"""
_COLUMNS = ["name", "kind", "context", "location", "visibility", "container"]


def _rows(v: Views) -> DataFrame:
    return reports.symbol_rows(v.symbols, F.concat("file", F.lit(":"), F.col("start_pos").cast("string")))


def _lines(form: str, sql: str) -> None:
    add(f"k1_{form}", lambda v: _rows(v).select("id", reports.line(_COLUMNS, form).alias("line")), f"SELECT id, {sql} AS line FROM ({_ROWS})")


# outputs
_quoted = lambda c: f"CASE WHEN regexp_matches({c}, '[,\"\\r\\n]') THEN '\"' || replace({c}, '\"', '\"\"') || '\"' ELSE {c} END"
_lines("csv", "concat_ws(',', " + ", ".join(map(_quoted, _COLUMNS)) + ")")
_lines("tsv", "concat_ws(chr(9), " + ", ".join(_COLUMNS) + ")")
_lines("jsonl", "CAST(to_json({" + ", ".join(f"'{c}': {c}" for c in _COLUMNS) + "}) AS VARCHAR)")
_lines("text", "format('{:<10} {:<30} [{}] {}{}', kind, name, context, location, CASE WHEN container <> '' THEN ' in ' || container ELSE '' END)")
add("k2_targeted", lambda v: reports.targeted(v.edges.where("kind = 'implements'").select(F.col("dst").alias("target_id"), F.col("src").alias("id")), _rows(v)).select("target_id", "count", F.array_join("results.name", ",").alias("names"), F.array_join("results.context", ",").alias("contexts")), f"SELECT e.dst AS target_id, count(*) AS count, string_agg(name, ',' ORDER BY id) AS names, string_agg(context, ',' ORDER BY id) AS contexts FROM v_edges e JOIN ({_ROWS}) r ON r.id = e.src WHERE e.kind = 'implements' GROUP BY 1")


def _usages(v: Views) -> DataFrame:
    used = reports.usage_files(joins.definitions(v.refs, v.symbols), v.bindings)
    return used.select("file", "context", "count", F.array_join(F.transform("usages", lambda u: F.concat_ws("-", u["start_pos"].cast("string"), u["end_pos"].cast("string"), u["def_name"])), ";").alias("usages"), F.array_join("import_via", ";").alias("import_via"))


add("k3_usages", _usages, """WITH d AS (SELECT r.file, r.start_pos, r.end_pos, s.name, s.file AS df FROM v_refs r LEFT JOIN v_symbols s ON s.id = r.symbol_id),
  u AS (SELECT file, count(*) AS count, string_agg(concat_ws('-', start_pos, end_pos, name), ';' ORDER BY start_pos, end_pos, name) AS usages FROM d GROUP BY 1),
  i AS (SELECT file, string_agg(DISTINCT import_text, ';' ORDER BY import_text) AS via FROM (SELECT d.file, b.import_text FROM d JOIN v_bindings b ON b.file = d.file AND b.source_file = d.df AND b.original_name = d.name) GROUP BY 1)
  SELECT u.file, CASE WHEN u.file LIKE '%/tests/%' OR u.file LIKE '%\\_test.go' ESCAPE '\\' THEN 'test' ELSE 'prod' END AS context, count, usages, coalesce(via, '') AS import_via FROM u LEFT JOIN i ON i.file = u.file""")
add("k4_file_list", lambda v: reports.file_list(v.deps.where("kind = 'include'"), "to_file", "from_file", "includers").withColumn("files", F.array_join("files", ",")), "SELECT to_file AS source_file, 'includers' AS relation, false AS transitive, count(*) AS count, string_agg(from_file, ',' ORDER BY from_file) AS files FROM (SELECT DISTINCT to_file, from_file FROM v_deps WHERE kind = 'include') GROUP BY 1")
add("k5_duplicates", lambda v: reports.duplicate_report(stats.duplicate_groups(v.symbols, 3, "method")).withColumn("ids", F.array_join("ids", ",")), "SELECT left(s.content_hash, 8) AS hash, s.content_hash, count(*) AS count, string_agg(id, ',' ORDER BY id) AS ids FROM v_symbols s WHERE content_hash IN (SELECT content_hash FROM v_symbols WHERE kind = 'method' GROUP BY 1 HAVING count(*) >= 3) GROUP BY 2")
add("k6_stats", lambda v: reports.by_count(v.symbols, "kind").select(F.array_join(F.transform("counts", lambda x: F.concat_ws(":", x["key"], x["n"].cast("string"))), ",").alias("kinds")), "SELECT string_agg(kind || ':' || CAST(n AS VARCHAR), ',' ORDER BY n DESC, kind) AS kinds FROM (SELECT kind, count(*) AS n FROM v_symbols GROUP BY 1)")
add("k7_compact_outline", lambda v: reports.compact_outline(v.symbols), "SELECT file, count(*) AS n, string_agg(name || ' ' || CASE kind WHEN 'function' THEN 'fn' WHEN 'method' THEN 'm' WHEN 'class' THEN 'c' WHEN 'const' THEN 'const' WHEN 'namespace' THEN 'ns' ELSE '??' END || ' ' || CAST(start_pos AS VARCHAR), ',' ORDER BY start_pos, id) AS outline FROM v_symbols GROUP BY 1")


def _details(v: Views) -> DataFrame:
    d = reports.symbol_details(v.symbols.where("kind in ('namespace', 'class', 'function')"), v.edges, v.refs)
    told = lambda c: F.array_join(F.transform(c, lambda e: F.concat_ws(" ", e["k"], e["other"], e["n"].cast("string"))), ",").alias(c)
    return d.select("id", "name", told("outgoing"), told("incoming"), "n_refs", "ref_files")


add("k8_details", _details, """WITH n AS (SELECT src, dst, kind, count(*) AS n FROM v_edges GROUP BY 1, 2, 3),
  o AS (SELECT src AS id, string_agg(kind || ' ' || dst || ' ' || CAST(n AS VARCHAR), ',' ORDER BY kind, dst) AS t FROM n GROUP BY 1), i AS (SELECT dst AS id, string_agg(kind || ' ' || src || ' ' || CAST(n AS VARCHAR), ',' ORDER BY kind, src) AS t FROM n GROUP BY 1),
  r AS (SELECT symbol_id AS id, count(*) AS n_refs, count(DISTINCT file) AS ref_files FROM v_refs GROUP BY 1)
  SELECT s.id, name, coalesce(o.t, '') AS outgoing, coalesce(i.t, '') AS incoming, coalesce(n_refs, 0) AS n_refs, coalesce(ref_files, 0) AS ref_files FROM v_symbols s LEFT JOIN o ON o.id = s.id LEFT JOIN i ON i.id = s.id LEFT JOIN r ON r.id = s.id WHERE kind IN ('namespace', 'class', 'function')""")

# lookups and joins
add("p7_dependents", lambda v: v.deps.where("to_file = 'nation/3'").select("from_file", "kind"), "SELECT from_file, kind FROM v_deps WHERE to_file = 'nation/3'")
add("p7_edges_from", lambda v: v.edges.where("src = 'function#000000003'"), "SELECT src, dst, kind FROM v_edges WHERE src = 'function#000000003'")
add("p7_bindings", lambda v: v.bindings.where("file = '/ws/orders/1-URGENT.ts'").select("local_name", "source_file", "original_name", "import_text"), "SELECT local_name, source_file, original_name, import_text FROM v_bindings WHERE file = '/ws/orders/1-URGENT.ts'")
add("p7_by_hash", lambda v: v.symbols.join(v.symbols.where("id = 'method#000000001'").select("content_hash"), "content_hash", "left_semi").select("id"), "SELECT id FROM v_symbols WHERE content_hash = (SELECT content_hash FROM v_symbols WHERE id = 'method#000000001')")
add("p11_meta", lambda v: maintenance.meta_set(v.table("region").select(F.col("r_name").alias("key"), F.col("r_regionkey").cast("string").alias("value")), "ASIA", "new"), "SELECT r_name AS key, CASE WHEN r_name = 'ASIA' THEN 'new' ELSE CAST(r_regionkey AS VARCHAR) END AS value FROM region")
add("j10_namesakes", lambda v: joins.implementations_or_namesakes(v.edges, v.symbols, v.symbols.where("kind in ('class', 'const')")), """WITH t AS (SELECT id AS target_id, name FROM v_symbols WHERE kind IN ('class', 'const')),
  one AS (SELECT DISTINCT target_id, e.src AS id FROM t JOIN v_edges e ON e.dst = target_id JOIN v_symbols s ON s.id = e.src)
  SELECT target_id, id, 1 AS tier FROM one UNION ALL SELECT target_id, s.id, 2 FROM t JOIN v_symbols s ON s.name = t.name WHERE target_id NOT IN (SELECT target_id FROM one) AND t.name IN (SELECT name FROM v_symbols GROUP BY 1 HAVING count(*) > 1)""")
add("g11_adjacency", lambda v: graph.adjacency(v.deps)[1].where("file like 'nation/%'").select("file", F.array_join("files", ",").alias("files")), "SELECT to_file AS file, string_agg(from_file, ',' ORDER BY from_file) AS files FROM (SELECT DISTINCT from_file, to_file FROM v_deps WHERE to_file LIKE 'nation/%') GROUP BY 1")

# imports
_EXISTING = "SELECT '/ws/src/m' || CAST(p_partkey AS VARCHAR(20)) || CASE p_partkey % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '/index.ts' WHEN 2 THEN '.rs' ELSE '/mod.rs' END AS file FROM {part} WHERE p_partkey % 5 <> 0"


def _existing(v: Views) -> DataFrame:
    return v.spark.sql(_EXISTING, part=v.table("part"))


def _typescript(v: Views) -> DataFrame:
    p = v.table("part").select("p_partkey", F.lit("/ws/src/app.ts").alias("file"), F.concat(F.when(F.col("p_partkey") % 7 == 0, "pkg/m").otherwise("'./m"), "p_partkey", F.when(F.col("p_partkey") % 7 == 0, "").otherwise("'")).alias("s"))
    c = I.import_candidates(F.col("file"), F.col("s"))
    return I.first_existing(p, "p_partkey", c, _existing(v), F.get(c, F.lit(0)))


add("f4_imports", _typescript, "SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE '/ws/src/m' || CAST(p_partkey AS VARCHAR) || CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 4 = 0 THEN '.ts' WHEN p_partkey % 4 = 1 THEN '/index.ts' ELSE '' END END AS resolved FROM part")
add("f4_qualifier", lambda v: v.table("part").select("p_partkey", I.import_qualifier(F.lit("/ws/src/app.ts"), F.concat(F.lit("'../lib/"), "p_brand", F.lit(".js'"))).alias("q")), "SELECT p_partkey, '/ws/lib/' || p_brand AS q FROM part")


def _rust(v: Views) -> DataFrame:
    p = v.table("part").select("p_partkey", F.concat(F.when(F.col("p_partkey") % 3 == 0, "crate::m").when(F.col("p_partkey") % 3 == 1, "super::m").otherwise("m"), "p_partkey", F.lit("::Thing")).alias("u"), F.when(F.col("p_partkey") % 3 == 2, "/ws/src/main.rs").otherwise("/ws/src/a/b.rs").alias("file"))
    return I.first_existing(p, "p_partkey", I.module_candidates(F.col("u"), F.col("file"), F.lit("/ws/src")), _existing(v))


add("f5_modules", _rust, "SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN CASE p_partkey % 4 WHEN 2 THEN '/ws/src/m' || CAST(p_partkey AS VARCHAR) || '.rs' WHEN 3 THEN '/ws/src/m' || CAST(p_partkey AS VARCHAR) || '/mod.rs' END END AS resolved FROM part")
add("f12_identifier_matches", lambda v: v.symbols.select("id", I.identifier_matches(F.when(F.col("is_test"), "class").otherwise(F.col("container")), F.col("name")).alias("m")), "SELECT id, CASE WHEN is_test THEN true ELSE container = name END AS m FROM v_symbols")
add("f22_duration", lambda v: v.runs.select("event_id", I.duration(F.floor(F.col("wall_time") * 60).cast("double")).alias("d")), "SELECT event_id, CASE WHEN s < 60 THEN printf('%.1fs', s::DOUBLE) WHEN s < 3600 THEN CAST(s // 60 AS VARCHAR) || 'm ' || CAST(s % 60 AS VARCHAR) || 's' ELSE CAST(s // 3600 AS VARCHAR) || 'h ' || CAST(s % 3600 // 60 AS VARCHAR) || 'm' END AS d FROM (SELECT event_id, CAST(floor(wall_time * 60) AS BIGINT) AS s FROM v_runs)")

# telemetry and comparisons
_KIND = "CASE tool_name WHEN 'Read' THEN 'read_to_structure' WHEN 'Grep' THEN 'grep_to_usages' WHEN 'Glob' THEN 'find_grep_to_symbols' WHEN 'Bash' THEN 'grep_to_symbols' ELSE 'other' END"


def _opportunities(v: Views) -> DataFrame:
    return v.calls.select("call_id", "session_id", F.expr(_KIND).alias("type"), F.col("result_tokens").alias("saved"))


add("p14_impact", lambda v: _opportunities(v).select("call_id", reports.impact(F.col("saved")).alias("impact")), "SELECT call_id, CASE WHEN result_tokens >= 1000 THEN 'high' WHEN result_tokens >= 500 THEN 'medium' ELSE 'low' END AS impact FROM v_calls")
add("a14_recommendations", lambda v: reports.recommendations(_opportunities(v)), f"SELECT CAST(CASE {_KIND} WHEN 'read_to_structure' THEN 1 WHEN 'grep_to_usages' THEN 2 WHEN 'find_grep_to_symbols' THEN 5 ELSE 6 END AS INTEGER) AS priority, {_KIND} AS type, count(*) AS n, CAST(sum(result_tokens) AS BIGINT) AS saved FROM v_calls WHERE tool_name IN ('Read', 'Grep', 'Glob', 'Bash') GROUP BY 2, 1")
add("o6_by_count", lambda v: reports.by_count(v.calls, "tool_name").select(F.posexplode("counts").alias("place", "x")).select("place", "x.key", "x.n"), "SELECT CAST(row_number() OVER (ORDER BY n DESC, tool_name) - 1 AS INTEGER) AS place, tool_name AS key, n FROM (SELECT tool_name, count(*) AS n FROM v_calls GROUP BY 1)")
add("o7_opportunities", lambda v: reports.ranked_opportunities(_opportunities(v), ["call_id"]).limit(20).select("call_id", "saved"), "SELECT call_id, result_tokens AS saved FROM v_calls ORDER BY 2 DESC, 1 LIMIT 20")
add("w6_history", lambda v: C.call_history(v.calls.where("call_id % 3 = 0"), "session_id", ["ts", "call_id"]).select("call_id", F.size("reads").cast("long").alias("reads"), F.array_join("greps", ",").alias("greps")), "SELECT call_id, count(*) FILTER (tool_name = 'Read') OVER w AS reads, coalesce(string_agg(CASE WHEN tool_name = 'Grep' THEN pattern END, ',') OVER w, '') AS greps FROM v_calls WHERE call_id % 3 = 0 WINDOW w AS (PARTITION BY session_id ORDER BY ts, call_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")


def _summary(v: Views) -> DataFrame:
    calls = v.calls.withColumn("command_type", F.when(F.col("tool_name") == "Bash", F.when(F.col("call_id") % 2 == 0, "grep").otherwise("find")))
    t = C.transcript_summary(calls, _opportunities(v).where("saved >= 1000"), "session_id")
    told = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["k"], x["n"].cast("string"))), ",").alias(c)
    return t.select("session_id", "calls", "tokens", told("tools"), F.coalesce(told("commands"), F.lit("")).alias("commands"), "saved", F.round("saved_pct", 4).alias("saved_pct"))


add("a12_summary", _summary, """WITH t AS (SELECT session_id, tool_name AS k, count(*) AS n FROM v_calls GROUP BY 1, 2), c AS (SELECT session_id, CASE WHEN call_id % 2 = 0 THEN 'grep' ELSE 'find' END AS k, count(*) AS n FROM v_calls WHERE tool_name = 'Bash' GROUP BY 1, 2),
  a AS (SELECT session_id, count(*) AS calls, CAST(sum(result_tokens) AS BIGINT) AS tokens, CAST(coalesce(sum(result_tokens) FILTER (result_tokens >= 1000), 0) AS BIGINT) AS saved FROM v_calls GROUP BY 1)
  SELECT a.session_id, calls, tokens, (SELECT string_agg(k || ':' || CAST(n AS VARCHAR), ',' ORDER BY k) FROM t WHERE t.session_id = a.session_id) AS tools, coalesce((SELECT string_agg(k || ':' || CAST(n AS VARCHAR), ',' ORDER BY k) FROM c WHERE c.session_id = a.session_id), '') AS commands, saved, round(CASE WHEN tokens > 0 THEN saved * 100.0 / tokens ELSE 0 END, 4)::DOUBLE AS saved_pct FROM a""")
_PAIR = "count(*) FILTER (condition = '{c}') AS {p}n, avg(wall_time) FILTER (condition = '{c}') AS {p}m, stddev_samp(wall_time) FILTER (condition = '{c}') AS {p}s"


def _p_values(v: Views) -> DataFrame:
    side = lambda c, p: [f(F.when(F.col("condition") == c, F.col("wall_time"))).alias(p + x) for x, f in (("n", F.count), ("m", F.avg), ("s", F.stddev_samp))]
    t = v.runs.groupBy("task_id").agg(*side("control", "c"), *side("treatment", "t")).where("cn > 1 and tn > 1")
    w = stats.welch(*[F.col(x) for x in ("cm", "cs", "cn", "tm", "ts", "tn")])
    t = t.select("task_id", w["t"].alias("t"), w["df"].alias("df")).withColumn("p", stats.p_of_t(F.col("t"), F.col("df")))
    return t.select("task_id", F.round("p", 5).alias("p"), stats.stars_by_p(F.col("p")).alias("stars"))


# Student's density, integrated by Simpson's rule
add("b6_p_values", _p_values, f"""WITH a AS (SELECT task_id, {_PAIR.format(c='control', p='c')}, {_PAIR.format(c='treatment', p='t')} FROM v_runs GROUP BY 1), b AS (SELECT task_id, cs * cs / cn AS v1, ts * ts / tn AS v2, * FROM a WHERE cn > 1 AND tn > 1),
  c AS (SELECT task_id, abs(cm - tm) / sqrt(v1 + v2) AS t, (v1 + v2) * (v1 + v2) / (v1 * v1 / (cn - 1) + v2 * v2 / (tn - 1)) AS n FROM b),
  d AS (SELECT task_id, sum(CASE WHEN k IN (0, 600) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * pow(1 + (t * k / 600) * (t * k / 600) / n, -(n + 1) / 2)) * t / 1800 * exp(lgamma((n + 1) / 2) - lgamma(n / 2)) / sqrt(n * pi()) AS half FROM c, range(0, 601) r(k) GROUP BY task_id, t, n)
  SELECT task_id, round(1 - 2 * half, 5) AS p, CASE WHEN 1 - 2 * half < 0.001 THEN '***' WHEN 1 - 2 * half < 0.01 THEN '**' WHEN 1 - 2 * half < 0.05 THEN '*' ELSE '' END AS stars FROM d""")


def _insights(v: Views) -> DataFrame:
    mean = lambda c, w: F.avg(F.when(F.col("condition") == w, F.col(c)))
    n = lambda tool, w: F.count_if((F.col("condition") == w) & (F.col("tool") == tool))
    pct = lambda c: stats.change(mean(c, "control"), mean(c, "treatment"))[1]
    t = v.runs.groupBy("task_id").agg(pct("wall_time").alias("a"), pct("tokens_in").alias("b"), ((n("view", "control") - n("view", "treatment")) / 4).alias("c"), ((n("click", "control") - n("click", "treatment")) / 4).alias("d"))
    return t.select("task_id", F.array_join(reports.insights(F.col("a"), F.col("b"), F.col("c"), F.col("d")), "; ").alias("insights"))


_MEAN = "avg({0}) FILTER (condition = '{1}')"
_PCT = "(" + _MEAN + " - " + _MEAN.replace("{1}", "{2}") + ") / " + _MEAN.replace("{1}", "{2}") + " * 100"
_FEWER = "(count(*) FILTER (condition = 'control' AND tool = '{0}') - count(*) FILTER (condition = 'treatment' AND tool = '{0}')) / 4.0"
add("b9_insights", _insights, f"""SELECT task_id, concat_ws('; ', CASE WHEN a < -20 THEN 'Treatment is ' || printf('%.0f', abs(a)) || '% faster' WHEN a > 20 THEN 'Treatment is ' || printf('%.0f', a) || '% slower' END,
  CASE WHEN b < -10 THEN 'Token usage reduced by ' || printf('%.0f', abs(b)) || '%' WHEN b > 10 THEN 'Token usage increased by ' || printf('%.0f', b) || '%' END,
  CASE WHEN c > 1 THEN 'Grep calls reduced by ' || printf('%.1f', round(c + 1e-9, 1)) || ' on average' END, CASE WHEN d > 1 THEN 'Read calls reduced by ' || printf('%.1f', round(d + 1e-9, 1)) || ' on average' END) AS insights
  FROM (SELECT task_id, {_PCT.format('wall_time', 'treatment', 'control')} AS a, {_PCT.format('tokens_in', 'treatment', 'control')} AS b, ({_FEWER.format('view')})::DOUBLE AS c, ({_FEWER.format('click')})::DOUBLE AS d FROM v_runs GROUP BY 1)""")
add("b11_total_tokens", lambda v: v.runs.select("event_id", stats.total_tokens(F.col("tokens_in"), F.col("tokens_out"), F.col("event_id") % 9, F.lit(7)).cast("long").alias("cached"), stats.total_tokens(F.col("tokens_in"), F.col("tokens_out"), F.col("event_id") % 9, F.lit(7), False).cast("long").alias("plain")), "SELECT event_id, CAST(tokens_in + tokens_out + event_id % 9 + 7 AS BIGINT) AS cached, CAST(tokens_in + tokens_out AS BIGINT) AS plain FROM v_runs")


def _conditions(v: Views) -> DataFrame:
    # the names of the conditions are a handful
    a, b = reports.compared_conditions(sorted(r[0] for r in v.runs.select("condition").distinct().collect()))
    return v.runs.where(F.col("condition").isin(a, b)).groupBy("condition").agg(F.count("*").alias("n"))


add("b12_conditions", _conditions, "SELECT condition, count(*) AS n FROM v_runs GROUP BY 1")
add("u1_by_id", lambda v: v.symbols.union(v.symbols.where("kind = 'class'")).dropDuplicates(["id"]).select("id", "name"), "SELECT id, name FROM v_symbols")
add("f30_glob", lambda v: v.symbols.select("id", T.glob_match(F.col("file"), "/ws/*customer*.py").alias("m")), "SELECT id, file LIKE '/ws/%customer%.py' AS m FROM v_symbols")
