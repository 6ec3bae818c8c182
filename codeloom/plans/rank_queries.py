"""Rank tests of many groups, with SQL that counts the orders of two samples by recursion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats
from .registry import add

add(
    "b7_exact_by_task",
    lambda v: stats.rank_tests(v.runs, ["task_id", "tool"], "condition", "control", "treatment", "wall_time").select("task_id", "tool", "n1", "n2", F.round("u", 3).alias("u"), F.round("z", 6).alias("z"), F.when(F.col("exact"), F.round("p", 6)).alias("p_exact")),
    """RECURSIVE WITH r AS (SELECT task_id, tool, condition, rank() OVER (PARTITION BY task_id, tool ORDER BY wall_time) + (count(*) OVER (PARTITION BY task_id, tool, wall_time) - 1) / 2.0 AS k, count(*) OVER (PARTITION BY task_id, tool, wall_time) AS c FROM v_runs),
s AS (SELECT task_id, tool, coalesce(sum(k) FILTER (condition = 'control'), 0) AS r1, count(*) FILTER (condition = 'control') AS n1, count(*) FILTER (condition = 'treatment') AS n2, sum(CAST(c AS DOUBLE) * c - 1) AS ties FROM r GROUP BY task_id, tool),
t AS (SELECT *, r1 - n1 * (n1 + 1) / 2.0 AS u, CASE WHEN n1 + n2 > 1 THEN sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - ties / (CAST(n1 + n2 AS DOUBLE) * (n1 + n2 - 1)))) END AS sd FROM s),
wide AS (SELECT coalesce(max(greatest(n1, n2)), 0) AS most FROM t WHERE least(n1, n2) <= 8),
orders(m, n, u, ways) AS (SELECT 0, 0, 0, CAST(1 AS DOUBLE)
  UNION ALL SELECT m, n, u, sum(ways) FROM (
    SELECT m + 1 AS m, n, u + n AS u, ways FROM orders WHERE m < 8 UNION ALL SELECT m, n + 1, u, ways FROM orders, wide WHERE n < most) GROUP BY m, n, u),
tails AS (SELECT t.task_id, t.tool, least(1.0, 2 * sum(ways) FILTER (o.u >= greatest(t.u, n1 * n2 - t.u)) / sum(ways)) AS p FROM t JOIN orders o ON o.m = least(n1, n2) AND o.n = greatest(n1, n2) GROUP BY t.task_id, t.tool)
SELECT task_id, tool, n1, n2, round(u, 3) AS u, CASE WHEN sd > 0 THEN round((abs(u - n1 * n2 / 2.0) - 0.5) / sd, 6) END AS z,
  CASE WHEN least(n1, n2) BETWEEN 2 AND 8 AND ties = 0 THEN round(p, 6) END AS p_exact FROM t LEFT JOIN tails USING (task_id, tool)""",
)
