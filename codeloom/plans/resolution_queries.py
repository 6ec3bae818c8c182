"""Queries of placeholder resolution and re-exports, with recursive SQL that walks each chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import resolution as R
from .registry import add
from .views import Views

_WALK = """WITH own AS (SELECT file, name, min(id) AS id FROM v_symbols GROUP BY file, name),
named AS (SELECT file, name, to_file, to_name FROM v_exports WHERE name <> '*'),
had AS (SELECT file, name FROM named UNION SELECT file, name FROM own),
pointers AS (SELECT * FROM named UNION ALL SELECT s.file, h.name, s.to_file, h.name FROM v_exports s JOIN had h ON h.file = s.to_file AND s.name = '*' ANTI JOIN had o ON o.file = s.file AND o.name = h.name),
walk AS (SELECT file, name, to_file, to_name FROM pointers UNION SELECT w.file, w.name, p.to_file, p.to_name FROM walk w JOIN pointers p ON p.file = w.to_file AND p.name = w.to_name),
passed AS (SELECT DISTINCT w.file, w.name, o.id FROM walk w JOIN own o ON o.file = w.to_file AND o.name = w.to_name)"""

add("j7_exported_names", lambda v: R.exported_names(v.exports, v.symbols), f"RECURSIVE {_WALK} SELECT file, name, id FROM passed")
add(
    "j7_references",
    lambda v: R.resolved_references(v.uses, v.imported, R.symbol_table(v.symbols)).select("ref_id", "file", "symbol_id"),
    "SELECT u.ref_id, u.file, CASE WHEN u.ref_id % 4 < 2 THEN s.id ELSE u.symbol_id END AS symbol_id FROM v_uses u JOIN customer ON c_custkey = u.ref_id JOIN v_symbols s ON s.kind = 'class' AND s.start_pos = c_nationkey * 100",
)
add(
    "j8_all_keys",
    lambda v: R.resolved_edges(v.placeholders, R.symbol_table(v.symbols, v.exports)).select("src", "dst", "kind"),
    f"""RECURSIVE {_WALK}, classes AS (SELECT id, name, file FROM v_symbols WHERE kind = 'class')
  SELECT e.src, coalesce(c.id, p.id, e.dst) AS dst, e.kind FROM v_placeholders e
  LEFT JOIN classes c ON replace(replace(regexp_replace(regexp_replace(e.dst, '/([A-Z ]+)/[.][.]/', '/'), '/[.]/', '/'), '.ts::', '::'), '::', '.ts::') = c.file || '::' || c.name
  LEFT JOIN passed p ON replace(p.file, '.ts', '::') || p.name = e.dst""",
)


def _after_change(v: Views) -> DataFrame:
    """References resolved while the classes of one region were missing, then refreshed with these."""
    missing = v.symbols.where("kind = 'class' and file like '/ws/ASIA/%'")
    before = R.symbol_table(v.symbols.join(missing.select("id"), "id", "left_anti"))
    old = R.kept(R.resolved_references(v.uses, v.imported, before), "references")
    stem = F.regexp_replace("source_file", r"\.ts$", "")
    deps = v.imported.select(F.col("file").alias("from_file"), F.concat(stem, F.lit(".ts")).alias("to_file")).distinct()
    affected = R.affected_files(missing.select("file").distinct(), deps)
    table = R.symbol_table(v.symbols)
    return R.refreshed(old, v.uses, affected, lambda raw: R.resolved_references(raw, v.imported, table)).select("ref_id", "file", "symbol_id")


add(
    "st3_refresh",
    _after_change,
    "SELECT u.ref_id, u.file, CASE WHEN u.ref_id % 4 < 2 THEN s.id ELSE u.symbol_id END AS symbol_id FROM v_uses u JOIN customer ON c_custkey = u.ref_id JOIN v_symbols s ON s.kind = 'class' AND s.start_pos = c_nationkey * 100",
)
