"""Lines and columns of offsets spread over all documents, with SQL that counts line feeds before each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import positions as P
from .registry import add
from .views import Views

#: Characters between the offsets that are looked up.
STEP = 211


def _documents(v: Views) -> tuple[DataFrame, DataFrame]:
    docs = v.table("documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    probes = docs.where("content is not null").select(F.col("path").alias("file"), F.explode(F.sequence(F.lit(0).cast("long"), F.length("content").cast("long"), F.lit(STEP).cast("long"))).alias("offset"))
    return docs, probes.withColumn("probe_id", F.concat_ws("#", "file", "offset"))


def _positions(v: Views) -> DataFrame:
    docs, probes = _documents(v)
    return P.located(probes, P.line_table(docs, in_bytes=False)).select("file", "offset", "line", "col")


def _snippets(v: Views) -> DataFrame:
    docs, probes = _documents(v)
    lines = P.line_table(docs, in_bytes=False)
    return P.with_context(P.located(probes, lines), lines, 1)


_PROBES = f"""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS file, text FROM documents WHERE text IS NOT NULL),
probes AS (SELECT file, text, unnest(range(0, length(text) + 1, {STEP})) AS p FROM d),
heads AS (SELECT file, text, p, substr(text, 1, CAST(p AS INTEGER)) AS head FROM probes),
places AS (SELECT file, text, CAST(p AS BIGINT) AS p, CAST(length(head) - length(replace(head, chr(10), '')) + 1 AS BIGINT) AS line,
  CAST(CASE WHEN contains(head, chr(10)) THEN strpos(reverse(head), chr(10)) ELSE length(head) + 1 END AS BIGINT) AS col FROM heads)"""

add("p12_positions", _positions, f'{_PROBES} SELECT file, p AS "offset", line, col FROM places')
add(
    "f14_context",
    _snippets,
    f"{_PROBES} SELECT file || '#' || p AS probe_id, greatest(line - 1, 1) AS first_line, array_to_string(list_slice(string_split(text, chr(10)), greatest(line - 1, 1), line + 1), chr(10)) AS snippet FROM places",
)
