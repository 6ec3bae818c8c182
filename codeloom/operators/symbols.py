"""Filtered, paged and full-text search over symbols."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import glob_match, glob_to_like, like_escaped


def list_symbols(symbols: DataFrame, file=None, kind=None, name=None, limit: int | None = None) -> DataFrame:
    """Equality on each given field, by id."""
    for c, v in (("file", file), ("kind", kind), ("name", name)):
        symbols = symbols if v is None else symbols.where(F.col(c) == v)
    return symbols if limit is None else symbols.orderBy("id").limit(limit)


@dataclass(frozen=True)
class Query:
    """All given conditions hold together. Names: exact before pattern before contains."""

    file: str | None = None
    kind: str | None = None
    name: str | None = None
    name_pattern: str | None = None
    name_contains: str | None = None
    name_fts: str | None = None
    namespace: str | None = None
    scope: str | None = None
    after: str | None = None
    case_insensitive: bool = False
    limit: int | None = None
    offset: int | None = None
    compat: bool = True


def file_condition(file: Column, pattern: str) -> Column:
    """Glob, folder, absolute file, or relative file (any file that ends so)."""
    p = pattern.replace("\\", "/")
    if "*" in p:
        like = glob_to_like(p.replace("?", "\\?"), True)
        return file.ilike(like) if p.startswith("/") else file.ilike(like) | file.ilike("%/" + like)
    if p.endswith("/"):
        return file.startswith(p) if p.startswith("/") else file.startswith(p) | file.contains("/" + p)
    if "." not in p.rpartition("/")[2]:
        return (file == p) | file.startswith(p + "/") if p.startswith("/") else (file == p) | file.startswith(p + "/") | file.contains("/" + p + "/")
    return file == p if p.startswith("/") else (file == p) | file.endswith("/" + p)


def name_condition(q: Query) -> Column | None:
    name = F.col("name")
    if q.name is not None:
        return F.lower(name) == q.name.lower() if q.case_insensitive else name == q.name
    text = q.name_pattern if q.name_pattern is not None else q.name_contains
    if text is None:
        return None
    like = glob_to_like(text, q.compat) if q.name_pattern is not None else "%" + (text if q.compat else like_escaped(text)) + "%"
    return name.ilike(like) if q.compat or q.case_insensitive else name.like(like)


def conditions(q: Query) -> list[Column]:
    out = []
    if q.file:
        out.append(file_condition(F.col("file"), q.file))
    if q.kind:
        out.append(F.col("kind") == q.kind)
    if (c := name_condition(q)) is not None:
        out.append(c)
    if q.namespace:
        ns = F.col("qualifier")
        out.append(ns.ilike(glob_to_like(q.namespace)) if "*" in q.namespace else (ns == q.namespace) | ns.startswith(q.namespace + "::"))
    if q.scope:
        out.append(F.col("container") == q.scope)
    if q.after:
        out.append(F.col("id") > q.after)
    return out


def search(symbols: DataFrame, q: Query) -> DataFrame:
    """The symbols that meet ``q``. Without limit and offset no order is imposed."""
    if q.name_fts:
        hits = full_text(symbols, q.name_fts)
        return search(hits, replace(q, name_fts=None, name=None, name_pattern=None, name_contains=None))
    cs = conditions(q)
    out = symbols.where(reduce(Column.__and__, cs)) if cs else symbols
    if q.limit is None and q.offset is None:
        return out
    out = out.orderBy("id")
    out = out.offset(q.offset) if q.offset else out
    return out if q.limit is None else out.limit(q.limit)


def full_text(symbols: DataFrame, query: str) -> DataFrame:
    """Words of three characters or more, each anywhere in name or qualifier, whatever the case.

    ``name:`` and ``qualifier:`` pick a column, ``^`` anchors at the start, quotes hold a phrase,
    ``OR`` separates alternatives; a trailing ``*`` changes nothing. An empty query is an error, as
    are NOT and parentheses outside of quotes: ``fulltext`` has expressions for these.
    """
    if not query.strip():
        raise ValueError("empty full-text query")
    bare = re.sub(r'"[^"]*"', '""', query)
    if re.search(r"[()]|(^|\s)NOT(\s|$)", bare):
        raise ValueError("NOT and parentheses: combine fulltext.Phrase with &, | and ~")
    alternatives = []
    for part in re.split(r' OR (?=(?:[^"]*"[^"]*")*[^"]*$)', query):
        tests = []
        for term in _terms(part):
            column, _, rest = term.partition(":")
            columns = [column] if rest and column in ("name", "qualifier") else ["name", "qualifier"]
            word = rest if len(columns) == 1 else term
            anchored, word = word.startswith("^"), word.lstrip("^").rstrip("*").strip('"').lower()
            if len(word) < 3:
                tests.append(F.lit(False))
                continue
            tests.append(reduce(Column.__or__, [F.coalesce(F.lower(c).startswith(word) if anchored else F.lower(c).contains(word), F.lit(False)) for c in columns]))
        alternatives.append(reduce(Column.__and__, tests))
    return symbols.where(reduce(Column.__or__, alternatives))


def _terms(part: str) -> list[str]:
    import shlex

    return shlex.split(part, posix=False)


def ranked(hits: DataFrame, query: str) -> DataFrame:
    """Hits in the name first, then short names, then id."""
    word = query.rstrip("*").strip('"').lower()
    return hits.orderBy(~F.lower("name").contains(word), F.length("name"), "id")


def trigrams(symbols: DataFrame) -> DataFrame:
    """An index of (gram, id) over name and qualifier."""
    grams = lambda c: F.when(F.length(c) >= 3, F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(F.lower(c), i, F.lit(3)))).otherwise(F.array().cast("array<string>"))
    return symbols.select("id", F.explode(F.array_distinct(F.concat(grams(F.coalesce("name", F.lit(""))), grams(F.coalesce("qualifier", F.lit("")))))).alias("gram"))


def by_trigrams(symbols: DataFrame, index: DataFrame, word: str) -> DataFrame:
    """Candidates that have all grams of the word, then verified."""
    word = word.lower()
    grams = sorted({word[i : i + 3] for i in range(len(word) - 2)})
    ids = index.where(F.col("gram").isin(grams)).groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).select("id")
    return full_text(symbols.join(ids, "id", "left_semi"), word)


def post_filtered(hits: DataFrame, file: str | None = None, kind: str | None = None) -> DataFrame:
    """Conditions on full-text hits; a file with ``*`` is matched part by part."""
    if file:
        f = F.col("file")
        hits = hits.where(glob_match(f, file) if "*" in file else f.startswith(file) if file.endswith("/") or file.startswith("/") else f.endswith(file))
    return hits.where(F.col("kind") == kind) if kind else hits


def page(symbols: DataFrame, size: int, after: str | None = None) -> tuple[list, str | None]:
    """One keyset page and the cursor of the next, which is None at the end."""
    q = symbols.where(F.col("id") > after) if after else symbols
    rows = q.orderBy("id").limit(size + 1).collect()  # bounded by the page's size
    return rows[:size], rows[size - 1].id if len(rows) > size else None
