"""Queries of strong components and build order, over dependencies with cycles and a long chain."""

from __future__ import annotations

from ..operators import ordering
from .registry import add
from .views import Views

_FILES = "(SELECT from_file AS file FROM v_linked UNION SELECT to_file FROM v_linked)"


def _files(v: Views):
    return v.linked.select("from_file").union(v.linked.select("to_file")).distinct().withColumnRenamed("from_file", "file")


#: Only nations and regions are on cycles; what each reaches gives their components.
_PARTS = f"""WITH core AS (SELECT from_file AS a, to_file AS b FROM v_linked WHERE regexp_matches(from_file, '^(nation|region)/')),
reach AS (SELECT a, b FROM core UNION SELECT r.a, c.b FROM reach r JOIN core c ON c.a = r.b),
parts AS (SELECT x.a AS file, min(x.b) AS component, count(DISTINCT x.b) AS n FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a),
named AS (SELECT f.file, coalesce(component, f.file) AS component, coalesce(n, 1) AS n_files, n IS NOT NULL AS in_cycle FROM {_FILES} f LEFT JOIN parts p ON p.file = f.file)"""

add("g10_components", lambda v: ordering.strong_components(v.linked.selectExpr("from_file as a", "to_file as b"), _files(v).withColumnRenamed("file", "node")).withColumnRenamed("node", "file"), f"RECURSIVE {_PARTS} SELECT file, component FROM named")
add(
    "g10_build_order",
    lambda v: ordering.build_order(v.linked, _files(v)),
    f"""RECURSIVE {_PARTS},
links AS (SELECT DISTINCT x.component AS a, y.component AS b FROM v_linked JOIN named x ON x.file = from_file JOIN named y ON y.file = to_file WHERE x.component <> y.component),
low AS (SELECT component, CASE WHEN component LIKE 'nation/%' AND NOT in_cycle THEN 1 ELSE 0 END AS level FROM (SELECT DISTINCT component, in_cycle FROM named WHERE regexp_matches(component, '^(nation|region)/'))),
suppliers AS (SELECT l.a AS component, max(low.level) + 1 AS level FROM links l JOIN low ON low.component = l.b WHERE l.a LIKE 'supplier/%' GROUP BY l.a),
parts_ AS (SELECT l.a AS component, max(s.level) + 1 AS level FROM links l JOIN suppliers s ON s.component = l.b WHERE l.a LIKE 'part/%' GROUP BY l.a),
own AS (SELECT CAST(replace(l.a, 'customer/', '') AS BIGINT) AS k, max(low.level) + 1 AS level FROM links l JOIN low ON low.component = l.b WHERE l.a LIKE 'customer/%' GROUP BY l.a),
chain AS (SELECT k, level FROM own WHERE k = (SELECT min(k) FROM own) UNION ALL SELECT o.k, greatest(o.level, c.level + 1) FROM chain c JOIN own o ON o.k = c.k + 1),
levels AS (SELECT * FROM low UNION ALL SELECT * FROM suppliers UNION ALL SELECT * FROM parts_ UNION ALL SELECT 'customer/' || CAST(k AS VARCHAR(20)), level FROM chain)
SELECT n.file, n.component, n.n_files, n.in_cycle, CAST(l.level AS BIGINT) AS level FROM named n JOIN levels l ON l.component = n.component""",
)
