"""The Jaccard join against all pairs of sets."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from codeloom.llm import jaccard

SCHEMA = "doc_id long, text string, cls string, n long, t long, c string, tokens long"


def plain_set(text):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(w[i : i + 3]) for i in range(max(len(w) - 2, 1))} if w else set()


def plain(rows):
    """(doc_id, n_shingles, component_id) of rows whose ids differ."""
    sets = {r[0]: plain_set(r[1]) for r in rows}
    ids = [x for x in sets if sets[x]]
    up = {x: x for x in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, x in enumerate(ids):
        for y in ids[:i]:
            n, m = len(sets[x]), len(sets[y])
            if 10 * min(n, m) >= 9 * max(n, m):
                both = len(sets[x] & sets[y])
                if 100 * both >= 90 * (n + m - both):
                    a, b = root(x), root(y)
                    up[max(a, b)] = min(a, b)
    return sorted((x, len(s), root(x)) for x, s in sets.items())


def edited(rng, words, n, vocabulary):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = rng.choice(vocabulary)
    return out


def corpus(seed=1):
    """Prose, near copies about the threshold in groups small and large, texts of frequent passages."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgàÉ") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    texts = [None, "", " \n", "one", "ONE", "one two", "one  two", "one two three", "É é", "x" * 5000]
    for size, copies in ((60, 2), (90, 3), (120, 50), (30, 5), (12, 4), (400, 4)):
        base = prose(size)
        texts += [" ".join(edited(rng, base, rng.randint(0, max(1, size // 50)), vocabulary)) for _ in range(copies)]
        texts += [" ".join(base), " ".join(base).upper(), "\n".join(base)]
    passages = [prose(50) for _ in range(4)]
    for _ in range(24):
        texts.append(" ".join(prose(rng.randint(40, 60)) + rng.choice(passages) + prose(5)))
    for _ in range(12):
        texts.append(" ".join([x for p in rng.sample(passages, 3) for x in p] + prose(2)))
    texts += [" ".join(prose(3000)) for _ in range(2)]
    rng.shuffle(texts)
    return [(10 * i, t, "c", 1, 2, "x", 3) for i, t in enumerate(texts)]


@pytest.mark.parametrize("how", ["as it is", "no counts, short lists", "one round"])
def test_similar_documents(spark, monkeypatch, how):
    if "short" in how or "round" in how:
        monkeypatch.setattr(jaccard, "SMALL", 3)
        monkeypatch.setattr(jaccard, "READS", 0)
        monkeypatch.setattr(jaccard, "LEFT", 2)
        monkeypatch.setattr(jaccard, "FEW", 10)
        monkeypatch.setattr(jaccard, "PAIRS", 5)
        monkeypatch.setattr(jaccard, "QUERIES", 1 << 12)
        monkeypatch.setattr(jaccard, "MEMBERS", 1 << 14)
    if "no counts" in how or "round" in how:
        # the order says nothing of frequency, so that frequent shingles must be found and put last
        monkeypatch.setattr(jaccard, "shingle_counts", lambda texts: np.zeros(jaccard.BUCKETS, np.uint32))
    if "round" in how:
        monkeypatch.setattr(jaccard, "ROUNDS", 1)
        monkeypatch.setattr(jaccard, "STARS", 1)
    rows = corpus()
    found = jaccard.similar_documents(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    want = plain(rows)
    assert sorted(map(tuple, found)) == want
    assert max(Counter(x[2] for x in want).values()) > 25


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(7, text, *"abcde"), (7, text, *"abcde"), (None, text, *"abcde"), (7, "other words are these", *"abcde"), (3, text.upper(), *"abcde"), (None, "alone here it is", *"abcde"), (None, None, *"abcde")]
    df = spark.createDataFrame(rows, "doc_id long, text string, cls string, n string, t string, c string, tokens string")
    found = Counter(map(tuple, jaccard.similar_documents(df).collect()))
    assert found == Counter([(7, 38, 3), (7, 38, 3), (None, 38, 3), (7, 2, 7), (3, 38, 3), (None, 2, None), (None, 0, None)])


def test_empty_table(spark):
    assert jaccard.similar_documents(spark.createDataFrame([], SCHEMA)).collect() == []


def test_prefixes_share_as_many_as_asked():
    """Sets with the overlap share l of their prefixes for l matches, whatever the order."""
    rng = np.random.default_rng(5)
    none = np.zeros(0, np.uint64)
    for _ in range(300):
        counts = rng.integers(0, 4, jaccard.BUCKETS).astype(np.uint32)
        x = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 120), np.uint64))
        y = np.unique(np.concatenate([rng.permutation(x)[: max(1, round(len(x) * rng.uniform(0.88, 1)))], rng.integers(0, 1 << 63, rng.integers(0, 5), np.uint64)]))
        both = jaccard.overlap(x, y)
        if jaccard.similar(both, len(x), len(y)):
            for k in range(1, min(jaccard.MATCHES, both) + 1):
                a, b = (jaccard.prefix(s, counts, none)[: len(s) - jaccard.least_overlap(len(s)) + k] for s in (x, y))
                assert len(np.intersect1d(a, b)) >= k


def test_counts_are_of_all_rows(spark):
    rows = corpus(2)
    total = jaccard.shingle_counts(spark.createDataFrame(rows, SCHEMA).repartition(5).select("text"))
    known = jaccard.WordHashes()
    want = np.zeros(jaccard.BUCKETS, np.int64)
    for r in rows:
        np.add.at(want, (jaccard.shingles(r[1], known) >> jaccard._SHIFT).astype(np.int64), 1)
    assert (total == want).all()
