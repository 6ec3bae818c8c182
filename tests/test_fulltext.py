"""Phrases, their combinations and their rank."""

import math

import pytest

from codeloom.operators import fulltext as T
from codeloom.operators.fulltext import Phrase

TEXTS = [("a", "getUser", "mod"), ("b", "setUser", "mod::user"), ("c", "notUser", None), ("d", "aaaaa", "xaaax"), ("e", None, None), ("f", "UserUser", "get"), ("f", "UserUser", "get"), ("g", "ab", "u"), (None, "getUser", "q"), ("h", "éàüüü", "get::get")]
SCHEMA = "id string, name string, qualifier string"


@pytest.fixture(scope="module")
def index(spark):
    return T.build_index(spark.createDataFrame(TEXTS, SCHEMA).repartition(3))


def found(index, q):
    return sorted(r.id for r in T.ranked(index, q).collect())


def test_combinations(index):
    user, get = Phrase("USER"), Phrase("get")
    assert found(index, user) == ["a", "b", "c", "f"]
    assert found(index, user & ~get) == ["b", "c"]
    assert found(index, (user | get) & ~Phrase("mod")) == ["c", "f", "h"]
    assert found(index, Phrase("user", column="qualifier")) == ["b"]
    assert found(index, Phrase("user", start=True)) == ["f"]
    assert found(index, Phrase("get", column="name", start=True)) == ["a"]
    assert found(index, Phrase("üüü") | Phrase("àü")) == ["h"]
    assert found(index, Phrase("ab")) == [] and found(index, Phrase("getUserX")) == []
    for bad in (~user, user | ~get, ~user & ~get):
        with pytest.raises(ValueError):
            T.ranked(index, bad)
    with pytest.raises(ValueError):
        Phrase(" ")
    with pytest.raises(ValueError):
        Phrase("abc", column="file")


def test_score(index):
    """By hand: eight texts; `aaa` stands five times in one of six grams."""
    q = Phrase("aaa")
    (row,) = T.ranked(index, q).collect()
    sizes = {i: max(len(a or "") - 2, 0) + max(len(b or "") - 2, 0) for i, a, b in TEXTS if i}
    mean = sum(sizes.values()) / len(sizes)
    f = 3 + 1
    want = math.log((8 - 1 + 0.5) / 1.5) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * sizes["d"] / mean))
    assert row.id == "d" and abs(row.score - want) < 1e-9


def test_only_the_grams_of_the_query_are_read(index):
    plan = T.occurrences(index, Phrase("user"))._jdf.queryExecution().toString()
    assert "In(gram, [ser,use])" in plan


def test_empty(spark):
    empty = T.build_index(spark.createDataFrame([], SCHEMA))
    assert T.ranked(empty, Phrase("abc")).collect() == []
