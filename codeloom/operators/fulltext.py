"""Full-text search over a stored index of grams with places, ranked by BM25.

A query is an expression of phrases: ``(Phrase("get") | Phrase("set", column="name")) & ~Phrase("test")``. A
phrase is any text of three characters or more; it matches wherever its grams stand one after another in a
column, so anywhere inside a word, whatever the case. Only the grams of the query's phrases are read: the index
is sorted by gram, so that a scan skips the row groups of all others.

Edge cases: null columns have no grams; a phrase of under three characters matches nothing, as
nothing is stored for it; a query of which only excluded phrases could match is an error, as is an empty
phrase; equal ranks go by id; rows that repeat an id count as one text.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph
from .graph import dealt, kept, parts_of

GRAM = 3
#: The constants of BM25, and the least weight of a phrase.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
COLUMNS = ("name", "qualifier")


class Expression:
    """What phrases are combined to; ``&``, ``|`` and ``~`` make new ones."""

    def __and__(self, other: Expression) -> Expression:
        return All((self, other))

    def __or__(self, other: Expression) -> Expression:
        return Any((self, other))

    def __invert__(self) -> Expression:
        return Not(self)


@dataclass(frozen=True)
class Phrase(Expression):
    """A text, in one column or in any; ``start`` asks for it at the column's beginning."""

    text: str
    column: str | None = None
    start: bool = False

    def __post_init__(self):
        if not self.text.strip():
            raise ValueError("empty phrase")
        if self.column is not None and self.column not in COLUMNS:
            raise ValueError(f"no column {self.column}")


@dataclass(frozen=True)
class All(Expression):
    parts: tuple


@dataclass(frozen=True)
class Any(Expression):
    parts: tuple


@dataclass(frozen=True)
class Not(Expression):
    part: Expression = field()


def phrases(query: Expression) -> list[Phrase]:
    if isinstance(query, Phrase):
        return [query]
    below = (query.part,) if isinstance(query, Not) else query.parts
    return list(dict.fromkeys(p for x in below for p in phrases(x)))


def matches_something(query: Expression) -> bool:
    """Whether some phrase must be there for the query to match."""
    if isinstance(query, Not):
        return False
    if isinstance(query, Phrase):
        return True
    return (any if isinstance(query, All) else all)(matches_something(x) for x in query.parts)


@dataclass(frozen=True)
class Index:
    """Stored tables: postings (gram, id, column, at) sorted by gram, and sizes (id, size)."""

    postings: DataFrame
    sizes: DataFrame
    n: int
    mean: float


def build_index(texts: DataFrame) -> Index:
    """The index of (id, name, qualifier).

    A gram that very many texts have is spread over ranges by id.
    """
    columns = [F.struct(F.lit(k).cast("byte").alias("column"), F.lower(F.col(c)).alias("text")) for k, c in enumerate(COLUMNS)]
    texts = texts.where("id is not null").select("id", *COLUMNS)
    rows = dealt(texts, texts.count() * len(COLUMNS), "id").dropDuplicates(["id"]).select("id", F.explode(F.array(*columns)).alias("c"))
    grams = F.when(F.length("c.text") >= GRAM, F.transform(F.sequence(F.lit(1), F.length("c.text") - (GRAM - 1)), lambda i: F.substring(F.col("c.text"), i, F.lit(GRAM)))).otherwise(F.array().cast("array<string>"))
    rows = rows.select("id", "c.column", F.coalesce(grams, F.array().cast("array<string>")).alias("grams"))
    sizes = kept(rows.groupBy("id").agg(F.sum(F.size("grams")).alias("size")), "sizes")
    post = rows.select("id", "column", F.posexplode("grams").alias("at", "gram"))
    total = sizes.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    parts = parts_of(texts.sparkSession, total[1], graph.ROWS)
    post = kept(post.repartitionByRange(parts, "gram", "id").sortWithinPartitions("gram", "id"), "postings")
    return Index(post, sizes, total[0], total[1] / max(total[0], 1))


def occurrences(index: Index, query: Expression) -> DataFrame:
    """(id, phrase, n): how often each phrase of the query, by its number, stands in each text."""
    wanted = []
    for k, p in enumerate(phrases(query)):
        text = p.text.lower()
        grams = [text[i : i + GRAM] for i in range(len(text) - GRAM + 1)]
        wanted += [(k, len(grams), -1 if p.column is None else COLUMNS.index(p.column), p.start, i, g) for i, g in enumerate(grams)]
    spark = index.postings.sparkSession
    asked = spark.createDataFrame(wanted, "phrase int, length int, only int, start boolean, offset int, asked string")
    # a filter on the query's few grams, so that the scan can skip; then each place once for each phrase
    rows = index.postings.where(F.col("gram").isin(sorted({w[5] for w in wanted}))) if wanted else index.postings.limit(0)
    n = rows.count()
    rows = rows.join(F.broadcast(asked), F.col("gram") == F.col("asked")).where("(only = -1 or only = column) and at >= offset and (not start or at = offset)")
    whole = dealt(rows, n, "id", "phrase").groupBy("phrase", "length", "id", "column", (F.col("at") - F.col("offset")).alias("place")).agg(F.count("*").alias("n")).where("n = length")
    return whole.groupBy("id", "phrase").agg(F.count("*").alias("n"))


def _holds(query: Expression, numbers: dict[Phrase, int]) -> Column:
    if isinstance(query, Phrase):
        return F.col(f"f{numbers[query]}") > 0
    if isinstance(query, Not):
        return ~_holds(query.part, numbers)
    return reduce(Column.__and__ if isinstance(query, All) else Column.__or__, [_holds(x, numbers) for x in query.parts])


def ranked(index: Index, query: Expression) -> DataFrame:
    """(id, score): the texts that match, with their BM25 score; the higher the better.

    The weight of a phrase is by the texts that have it, counted from the same postings.
    """
    if not matches_something(query):
        raise ValueError("a query needs a phrase that must be there")
    numbers = {p: k for k, p in enumerate(phrases(query))}
    found = kept(occurrences(index, query), "occurrences")
    # one row a phrase of the query
    texts = {r[0]: r[1] for r in found.groupBy("phrase").agg(F.count("*")).collect()}
    counts = [F.coalesce(F.sum(F.when(F.col("phrase") == k, F.col("n"))), F.lit(0)).alias(f"f{k}") for k in numbers.values()]
    n = max(found.count(), index.n)
    rows = dealt(found, n, "id").groupBy("id").agg(*counts).where(_holds(query, numbers)).join(dealt(index.sizes, n, "id"), "id")
    score = F.lit(0.0)
    for k in numbers.values():
        n = texts.get(k, 0)
        idf = F.greatest(F.log((F.lit(index.n - n) + 0.5) / (n + 0.5)), F.lit(LEAST_IDF))
        f = F.col(f"f{k}").cast("double")
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("size") / index.mean))
    return rows.select("id", score.alias("score"))


def search_ranked(symbols: DataFrame, index: Index, query: Expression, limit: int | None = None) -> DataFrame:
    """The symbols that match, with score, the best first where a limit is given."""
    hits = ranked(index, query)
    if limit is None:
        symbols = dealt(symbols, index.n, "id")
    else:
        hits = hits.orderBy(F.desc("score"), "id").limit(limit)
    return symbols.join(hits, "id")
