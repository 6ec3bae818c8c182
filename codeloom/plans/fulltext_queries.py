"""Ranked full-text queries, with SQL that counts every phrase at every place of every text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fulltext as T
from ..operators.fulltext import Phrase
from .registry import add

_QUERIES = {
    "p5_and_or_not": ((Phrase("customer") | Phrase("supplier", column="name")) & Phrase("00", start=False) | Phrase("customer") & ~Phrase("france") & ~Phrase("0001"), None),
    "p5_phrases": (Phrase("brand#1", column="qualifier") & (Phrase("green ") | Phrase("aaa") | ~Phrase("brand#11")), None),
    "p5_start": (Phrase("asia", start=True) | Phrase("tpch::a", column="qualifier", start=True) & ~Phrase("customer#00000001"), None),
    "o3_ranked": (Phrase("brand#1") | Phrase("red") | Phrase("000"), 25),
}


def _count(p: Phrase) -> str:
    text = p.text.lower().replace("'", "''")
    if len(text) < T.GRAM:
        return "0"
    columns = T.COLUMNS if p.column is None else (p.column,)
    one = lambda c: f"len(list_filter(range(1, greatest(length(coalesce({c}, '')) - {len(text) - 2}, 1)), lambda i: substr(lower({c}), i, {len(text)}) = '{text}'{' AND i = 1' if p.start else ''}))"
    return " + ".join(map(one, columns))


def _condition(q, numbers) -> str:
    if isinstance(q, Phrase):
        return f"f{numbers[q]} > 0"
    if isinstance(q, T.Not):
        return f"NOT ({_condition(q.part, numbers)})"
    return "(" + (" AND " if isinstance(q, T.All) else " OR ").join(_condition(x, numbers) for x in q.parts) + ")"


def _sql(q, limit) -> str:
    ps = T.phrases(q)
    numbers = {p: k for k, p in enumerate(ps)}
    idf = lambda k: f"greatest(ln((n - d{k} + 0.5) / (d{k} + 0.5)), {T.LEAST_IDF})"
    part = lambda k: f"{idf(k)} * f{k} * {T.K1 + 1} / (f{k} + {T.K1} * ({1 - T.B} + {T.B} * size / mean))"
    sql = f"""WITH counted AS (SELECT id, name, {', '.join(f'{_count(p)} AS f{k}' for k, p in enumerate(ps))},
  greatest(length(coalesce(name, '')) - 2, 0) + greatest(length(coalesce(qualifier, '')) - 2, 0) AS size FROM v_symbols),
totals AS (SELECT count(*) AS n, avg(size) AS mean, {', '.join(f'count(*) FILTER (f{k} > 0) AS d{k}' for k in range(len(ps)))} FROM counted)
SELECT id, name, round({' + '.join(map(part, range(len(ps))))}, 6) AS score FROM counted, totals WHERE {_condition(q, numbers)}"""
    return sql if limit is None else f"{sql} ORDER BY score DESC, id LIMIT {limit}"


for _name, (_query, _limit) in _QUERIES.items():
    add(_name, lambda v, q=_query, n=_limit: T.search_ranked(v.symbols, T.build_index(v.symbols), q, n).select("id", "name", F.round("score", 6).alias("score")), _sql(_query, _limit))
