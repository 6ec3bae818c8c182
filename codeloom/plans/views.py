"""Index-shaped views over the driver's tables, defined once as SQL that Spark and DuckDB share."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..operators.graph import dealt

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations", "benchmark")


def _id(kind: str, key: str) -> str:
    return f"'{kind}#' || lpad(CAST({key} AS VARCHAR(20)), 9, '0')"


def _symbol(kind: str, key: str, name: str, file: str, qualifier: str, container: str, visibility: str, content: str, source: str) -> str:
    return f"""SELECT {_id(kind, key)} AS id, {file} AS file, '{kind}' AS kind, {name} AS name, CAST({key} AS BIGINT) * 100 AS start_pos,
      CAST({key} AS BIGINT) * 100 + 10 + length({name}) AS end_pos, {qualifier} AS qualifier, {visibility} AS visibility, {container} AS container,
      substr(md5({content}), 1, 16) AS content_hash, {key} % 7 = 0 AS is_test FROM {source}"""


NULL = "CAST(NULL AS VARCHAR(20))"
VIEWS = {
    "v_symbols": " UNION ALL ".join([
        _symbol("namespace", "r_regionkey", "r_name", "'/ws/' || r_name || '.rs'", "'tpch'", NULL, "'pub'", "r_name", "{region}"),
        _symbol("class", "n_nationkey", "n_name", "'/ws/' || r_name || '/' || n_name || '.ts'", "'tpch::' || r_name", "r_name", "'public'", "n_name", "{nation} JOIN {region} ON n_regionkey = r_regionkey"),
        _symbol("method", "c_custkey", "c_name", "'/ws/' || n_name || '/tests/customer.py'", "'tpch::' || n_name || '::customer'", "n_name", "CASE WHEN c_custkey % 3 = 0 THEN 'private' ELSE 'public' END", "c_mktsegment || CAST(c_nationkey AS VARCHAR(20))", "{customer} JOIN {nation} ON c_nationkey = n_nationkey"),
        _symbol("function", "s_suppkey", "replace(s_name, '#', '_')", "'/ws/' || n_name || '/supplier_test.go'", "'tpch::' || n_name", "n_name", NULL, "s_name", "{supplier} JOIN {nation} ON s_nationkey = n_nationkey"),
        _symbol("const", "p_partkey", "p_name", "'/ws/parts/' || p_brand || '.kt'", "'parts::' || p_brand || '::' || p_type", "p_brand", "'pub'", "p_type || p_brand", "{part}"),
    ]),
    "v_edges": f"""SELECT {_id('class', 'n_nationkey')} AS src, {_id('namespace', 'n_regionkey')} AS dst, 'extends' AS kind FROM {{nation}}
      UNION ALL SELECT {_id('method', 'c_custkey')}, {_id('class', 'c_nationkey')}, 'implements' FROM {{customer}}
      UNION ALL SELECT {_id('function', 's_suppkey')}, {_id('class', 's_nationkey')}, 'trait_impl' FROM {{supplier}}
      UNION ALL SELECT {_id('function', 'a')}, {_id('function', 'b')}, 'calls' FROM
        (SELECT l_suppkey AS a, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS b FROM {{lineitem}}) t WHERE b IS NOT NULL
      UNION ALL SELECT {_id('function', 's_suppkey')}, n_name || '::' || replace(s_name, '#', '_'), 'calls' FROM {{supplier}} JOIN {{nation}} ON s_nationkey = n_nationkey""",
    "v_deps": """SELECT 'part/' || CAST(l_partkey AS VARCHAR(20)) AS from_file, 'supplier/' || CAST(l_suppkey AS VARCHAR(20)) AS to_file, 'import' AS kind FROM {lineitem}
      UNION ALL SELECT 'supplier/' || CAST(s_suppkey AS VARCHAR(20)), 'nation/' || CAST(s_nationkey AS VARCHAR(20)), 'import' FROM {supplier}
      UNION ALL SELECT 'customer/' || CAST(c_custkey AS VARCHAR(20)), 'nation/' || CAST(c_nationkey AS VARCHAR(20)), 'include' FROM {customer}
      UNION ALL SELECT 'nation/' || CAST(n_nationkey AS VARCHAR(20)), 'region/' || CAST(n_regionkey AS VARCHAR(20)), 'include' FROM {nation}""",
    "v_refs": f"""SELECT '/ws/' || n_name || '/supplier_test.go' AS file, l_suppkey * 100 + l_linenumber * 3 AS start_pos, l_suppkey * 100 + l_linenumber * 3 + 4 AS end_pos,
      {_id('function', 'l_suppkey')} AS symbol_id, l_orderkey * 10 + l_linenumber AS ref_id FROM {{lineitem}} JOIN {{supplier}} ON l_suppkey = s_suppkey JOIN {{nation}} ON s_nationkey = n_nationkey
      UNION ALL SELECT '/ws/orders/' || o_orderpriority || '.ts', o_orderkey * 20, o_orderkey * 20 + 9, {_id('method', 'o_custkey')}, -o_orderkey FROM {{orders}}""",
    "v_bindings": """SELECT '/ws/orders/' || p || '.ts' AS file, c_name AS local_name, '/ws/' || n_name || '/tests/customer.py' AS source_file, c_name AS original_name,
      'import ' || c_name || ' from ' || n_name AS import_text FROM (SELECT DISTINCT o_orderpriority AS p, o_custkey FROM {orders}) t
      JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey WHERE c_custkey % 2 = 0""",
    "v_calls": """SELECT user_id AS session_id, event_id AS call_id, ts, CASE event_type WHEN 'view' THEN 'Read' WHEN 'click' THEN 'Grep' WHEN 'error' THEN 'Bash' WHEN 'signup' THEN 'Glob' ELSE 'Edit' END AS tool_name,
      CAST(floor(value * 20) AS BIGINT) AS result_tokens, props,
      CASE event_id % 4 WHEN 0 THEN 'getUserName' WHEN 1 THEN 'two words' WHEN 2 THEN 'user_id' ELSE 'a' END AS pattern,
      '/ws/src/mod' || CAST(event_id % 3 AS VARCHAR(20)) || '.py' AS file_path, 'src/mod' || CAST(event_id % 2 AS VARCHAR(20)) || '.py:3: x' AS result FROM {events}""",
    "v_runs": """SELECT 'task' || CAST(user_id % 40 AS VARCHAR(20)) AS task_id, CASE WHEN event_id % 2 = 0 THEN 'control' ELSE 'treatment' END AS condition, event_id,
      event_type AS tool, value AS wall_time, CAST(floor(value * 1000) AS BIGINT) AS tokens_in, CAST(floor(value * 10) AS BIGINT) AS tokens_out, user_id % 3 <> 0 AS success FROM {events}""",
    "v_exports": """SELECT '/ws/x/' || CAST(k AS VARCHAR(20)) || '.ts' AS file, CASE WHEN k % 40 = 10 THEN '*' ELSE 'Fn' || CAST(k % 5 AS VARCHAR(20)) END AS name,
      CASE WHEN k % 40 = 0 THEN '/ws/' || n_name || '/tests/customer.py' ELSE '/ws/x/' || CAST(CASE WHEN k % 40 = 20 THEN k + 5 ELSE k - 1 END AS VARCHAR(20)) || '.ts' END AS to_file,
      CASE WHEN k % 40 = 0 THEN c_name WHEN k % 40 = 10 THEN '*' ELSE 'Fn' || CAST(CASE WHEN k % 40 = 20 THEN k + 5 WHEN k % 40 = 11 THEN k - 2 ELSE k - 1 END % 5 AS VARCHAR(20)) END AS to_name
      FROM (SELECT c_custkey AS k, c_name, n_name FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey) t""",
    "v_placeholders": """SELECT 'caller' || CAST(k AS VARCHAR(20)) AS src, CASE k % 7 WHEN 0 THEN '/ws/' || r || '/' || n || '.ts::' || n WHEN 1 THEN '/ws/' || r || '/' || n || '::' || n WHEN 2 THEN '/ws/./' || r || '/' || n || '::' || n
      WHEN 3 THEN '/ws/' || r || '/../' || r || '/' || n || '.ts::' || n WHEN 4 THEN 'lib::' || n WHEN 5 THEN '/ws/x/' || CAST(k AS VARCHAR(20)) || '::Fn' || CAST(k % 5 AS VARCHAR(20)) ELSE 'class#a::b' END AS dst, 'calls' AS kind
      FROM (SELECT c_custkey AS k, r_name AS r, n_name AS n FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey) t""",
    "v_imported": """SELECT '/ws/y/' || CAST(k % 9 AS VARCHAR(20)) || '.ts' AS file, 'Local' || CAST(k AS VARCHAR(20)) AS local_name, '/ws/' || r || '/' || n || CASE WHEN k % 2 = 0 THEN '.ts' ELSE '' END AS source_file, n AS original_name, 'import' AS import_text
      FROM (SELECT c_custkey AS k, r_name AS r, n_name AS n FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey) t""",
    "v_uses": """SELECT c_custkey AS ref_id, '/ws/y/' || CAST(c_custkey % 9 AS VARCHAR(20)) || '.ts' AS file, CASE c_custkey % 4 WHEN 0 THEN './x::Local' || CAST(c_custkey AS VARCHAR(20)) WHEN 1 THEN './x::' || n_name WHEN 2 THEN './x::Other' ELSE 'class#1::' || n_name END AS symbol_id
      FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "v_linked": """SELECT 'part/' || CAST(l_partkey AS VARCHAR(20)) AS from_file, 'supplier/' || CAST(l_suppkey AS VARCHAR(20)) AS to_file FROM {lineitem}
      UNION ALL SELECT 'supplier/' || CAST(s_suppkey AS VARCHAR(20)), 'nation/' || CAST(s_nationkey AS VARCHAR(20)) FROM {supplier}
      UNION ALL SELECT 'customer/' || CAST(c_custkey AS VARCHAR(20)), 'nation/' || CAST(c_nationkey AS VARCHAR(20)) FROM {customer}
      UNION ALL SELECT 'customer/' || CAST(c_custkey + 1 AS VARCHAR(20)), 'customer/' || CAST(c_custkey AS VARCHAR(20)) FROM {customer} WHERE c_custkey < (SELECT max(c_custkey) FROM {customer})
      UNION ALL SELECT 'nation/' || CAST(n_nationkey AS VARCHAR(20)), 'region/' || CAST(n_regionkey AS VARCHAR(20)) FROM {nation}
      UNION ALL SELECT 'region/' || CAST(n_regionkey AS VARCHAR(20)), 'nation/' || CAST(n_nationkey AS VARCHAR(20)) FROM {nation} WHERE n_regionkey < 2 AND n_nationkey % 2 = 0""",
}
#: Views that other views or queries read.
ORDER = tuple(VIEWS)


class Views:
    """The views as DataFrames over one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        sql = VIEWS[name]
        tables = {t: self.table(t) for t in TABLES if f"{{{t}}}" in sql}
        if name == "v_edges":
            # by the key of its window, in parts by the number of rows
            tables["lineitem"] = dealt(tables["lineitem"], tables["lineitem"].count(), "l_orderkey")
        return self.spark.sql(sql, **tables)

    symbols = cached_property(lambda self: self.view("v_symbols"))
    edges = cached_property(lambda self: self.view("v_edges"))
    deps = cached_property(lambda self: self.view("v_deps"))
    refs = cached_property(lambda self: self.view("v_refs"))
    bindings = cached_property(lambda self: self.view("v_bindings"))
    calls = cached_property(lambda self: self.view("v_calls"))
    runs = cached_property(lambda self: self.view("v_runs"))
    exports = cached_property(lambda self: self.view("v_exports"))
    placeholders = cached_property(lambda self: self.view("v_placeholders"))
    imported = cached_property(lambda self: self.view("v_imported"))
    linked = cached_property(lambda self: self.view("v_linked"))
    uses = cached_property(lambda self: self.view("v_uses"))


def with_views(sql: str) -> str:
    """``sql`` after the definitions of the views that it names."""
    names = [v for v in ORDER if v in sql]
    parts = [f"{v} AS ({VIEWS[v].format(**{t: t for t in TABLES})})" for v in names]
    recursive = sql.lstrip().startswith("RECURSIVE ")
    body = sql.lstrip().removeprefix("RECURSIVE ")
    if body.lstrip().startswith("WITH "):
        parts.append(body.lstrip()[5:])
        return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)}"
    return (f"WITH {', '.join(parts)} " if parts else "") + body
