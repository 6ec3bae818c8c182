"""Periodic runs against all periods at all places."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from codeloom.llm import periodic


def plain_runs(w):
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, b, q) for (a, b), q in out.items())


def plain(doc_id, text, tails=True):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if tails and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = sorted(plain_runs(w), key=lambda r: (r[0], r[2]))
    best = min(runs, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
    gone = {i for a, b, q in runs for i in range(a + q, b)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    told = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    return doc_id, len(runs), *told, sha("".join(f"{a},{b - a},{q}\n" for a, b, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))


def mixed_words(rng, n):
    k = rng.choice([1, 2, 2, 3, 5])
    w = []
    while len(w) < n:
        r = rng.random()
        if r < 0.4:
            w += [rng.randrange(k) for _ in range(rng.randint(1, 5))] * rng.randint(1, 7)
        elif r < 0.7 and w:
            i = rng.randrange(len(w))
            w += w[i : i + rng.randint(1, 40)]
        else:
            w.append(rng.randrange(k))
    return w


def test_runs_of_random_words():
    rng = random.Random(4)
    for _ in range(4000):
        w = mixed_words(rng, rng.randint(0, 70))
        assert periodic.runs(w) == plain_runs(w), w


def test_stretches_lose_no_run():
    rng = random.Random(5)
    for _ in range(600):
        texts = [mixed_words(rng, rng.randint(0, 50)) for _ in range(4)]
        texts = [[x + 9 * i for x in t] if rng.random() < 0.5 else t for i, t in enumerate(texts)]
        found = periodic.found_runs([np.array(t, np.int32) for t in texts])
        assert [sorted(x) for x in found] == [plain_runs(t) for t in texts], texts


def test_factors_are_the_longest_earlier_ones():
    rng = random.Random(6)
    for _ in range(500):
        w = mixed_words(rng, rng.randint(1, 40))
        at = 0
        for start, earlier in periodic.factors(w):
            assert start == at
            longest = max((k for k in range(1, len(w) - at + 1) if any(w[j : j + k] == w[at : at + k] for j in range(at))), default=0)
            if longest:
                assert earlier < at and w[earlier : earlier + longest] == w[at : at + longest]
            else:
                assert earlier == -1
            at += max(longest, 1)
        assert at == len(w)


def documents():
    rng = random.Random(7)
    name = lambda w: " ".join(f"wörd{x}" for x in w)
    texts = [None, "", " \t\n", "one", "a a a a a", "a a a a a a", "A a A a a a", "ab ab ab ab ab ab ab", "x y x y x y x y", "x y x y x y x", name(range(50)) + " " + "b " * 30, "q\x0bq\x0cq\r\nq q q", "é é " * 8]
    texts += [name(mixed_words(rng, rng.randint(1, 400))) for _ in range(80)]
    rows = [(i, t, "w", 1, 2, 3) for i, t in enumerate(texts)]
    return [*rows, rows[5], (None, "z " * 9, None, None, None, None), (10**15, "line one\nline two\n" * 200, "w", 1, 2, 3)]


SCHEMA = "doc_id long, text string, word string, n_runs long, start long, id long"


@pytest.mark.parametrize("tails", [True, False])
def test_periodic_runs(spark, tails):
    rows = documents()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = periodic.periodic_runs(df, repeat_tails=tails)
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r)[:8] for r in found.collect()), key=key) == sorted((plain(r[0], r[1], tails) for r in rows), key=key)
    for r in found.collect():
        assert hashlib.sha256(r.collapsed.encode()).hexdigest() == r.collapsed_sha256 and len(r.runs) == r.n_runs


def test_empty_table(spark):
    assert periodic.periodic_runs(spark.createDataFrame([], SCHEMA)).collect() == []


def test_very_long_texts(spark, monkeypatch):
    """Texts of some megabytes, cut into pieces when listed: one word, a long period, no run."""
    monkeypatch.setattr(periodic, "LISTED", 1 << 16)
    texts = ["ab " * 400_000, " ".join(f"w{i}" for i in range(50_000)) + " ", " ".join(str(i) for i in range(300_000))]
    texts[1] *= 5
    began = time.time()
    found = {r.doc_id: r for r in periodic.periodic_runs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert time.time() - began < 60
    assert (found[0].length, found[0].period, found[0].collapsed) == (400_000, 1, "ab")
    assert (found[1].length, found[1].period, found[1].n_runs) == (250_000, 50_000, 1)
    assert found[2].n_runs == 0 and found[2].collapsed == texts[2]


def test_given_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = periodic.periodic_runs(df, repeat_tails=True, with_text=False).collect()
    assert sorted(map(tuple, found)) == sorted(plain(r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
