import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codeloom.llm import substrings
from codeloom.llm.common import work_path


def texts(rng):
    block = bytes(rng.choice(b"abcdefgh ") for _ in range(170))
    gram = bytes(rng.choice(b"abcdefgh ") for _ in range(30))
    other = lambda n: bytes(rng.choice(b"abcdefgh ") for _ in range(n))
    out = [other(60) + gram + other(60) for _ in range(40)]
    return [*out, other(20) + block + other(70), block[30:] + other(50), block[:120], b"a" * 150, b"ab" * 80, b"a" * 150, other(99), b"", other(100)]


def test_only_recurring_strings_reach_the_suffix_array(monkeypatch):
    rng = random.Random(3)
    parts = [x for x in texts(rng) if len(x) >= 100]
    rng.shuffle(parts)
    sizes, real = [], substrings.suffix_ranks
    monkeypatch.setattr(substrings, "suffix_ranks", lambda data: sizes.append(len(data)) or real(data))
    place = np.array([(len(parts) - k, 7) for k in range(len(parts))])
    seg, offset, late, _ = substrings.repeats(parts, place)
    seen, want = {}, []
    for k in sorted(range(len(parts)), key=lambda k: tuple(place[k])):
        for i in range(len(parts[k]) - 99):
            if seen.setdefault(parts[k][i : i + 100], (k, i)) != (k, i):
                want.append((k, i))
    assert sorted(zip(seg[late].tolist(), offset[late].tolist(), strict=True)) == sorted(want)
    # three pieces of one block and the even texts, not forty texts that share 30 bytes
    assert len(sizes) == 1 and sizes[0] < 1000 < sum(len(x) for x in parts) // 5
    # without any string that occurs twice, no array at all
    sizes.clear()
    alone = [x for x in parts if b"ab" * 10 not in x and b"a" * 9 not in x][:3]
    few = [x[:101] for x in alone]
    assert not substrings.repeats(few, place[:3])[2].any() and not sizes


def test_ranks_are_groups_of_equal_strings():
    parts = [x for x in texts(random.Random(4)) if len(x) >= 100]
    data = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(x) for x in parts])
    at, n = np.cumsum(sizes) - sizes, sizes - 99
    starts = np.concatenate([np.arange(a, a + k) for a, k in zip(at, n, strict=True)])
    order = substrings.suffix_order(data, starts)
    rank = substrings.suffix_ranks(data)[order]
    lcp = substrings.common_prefixes(data, order, at, n)
    assert ((rank[1:] == rank[:-1]) == (lcp[1:] == 100)).all() and (rank[1:] >= rank[:-1]).all()


@pytest.mark.parametrize("kinds", [None, 64, 3])
def test_segments_name_every_start_by_its_bytes(kinds, monkeypatch):
    real = substrings.string_orders
    if kinds:  # many strings of one order
        monkeypatch.setattr(substrings, "string_orders", lambda data: real(data) % np.uint32(kinds))
    parts = texts(random.Random(5))
    sizes = np.array([len(x) for x in parts])
    data = np.frombuffer(b"".join(parts), np.uint8)
    begin = np.cumsum(sizes) - sizes
    x, grams = substrings.string_orders(data), substrings.string_names(data, np.arange(len(data) - 23))
    got = {}
    for name, text, at, n, twice in zip(*substrings.segments(data, sizes), strict=True):
        for s in range(at, at + n):
            assert begin[text] <= s <= begin[text] + sizes[text] - 100 and s not in got
            least = x[s : s + 77].min()
            assert name == grams[s : s + 77][x[s : s + 77] == least].min()
            got[s] = name
        if np.count_nonzero(grams[at : at + n + 76] == name) > 1:
            assert twice
    assert sorted(got) == [s for b, n in zip(begin, sizes, strict=True) for s in range(b, b + n - 99)]
    assert len({data[s : s + 100].tobytes() for s in got}) > 2000 and len(set(got.values())) > 30
    named = {}
    for s, name in got.items():
        assert named.setdefault(data[s : s + 100].tobytes(), name) == name


def test_pieces_of_slices_and_nulls(monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK", 5)
    batch = pa.RecordBatch.from_pydict({"text": ["zz", "é", None, "", "abcdef", None, "x", "yy"]}).slice(1, 6)
    got = [(list(rows), data.tobytes(), sizes.tolist()) for rows, data, sizes in substrings._pieces(batch)]
    assert got == [([0, 1, 2, 3], "éabcdef".encode(), [2, 0, 0, 6]), ([4, 5], b"x", [0, 1])]


def test_filter_of_several_blocks(spark):
    names = spark.range(600_000).select(F.xxhash64("id").alias("name"))
    out = work_path(spark, "filter")
    bits = substrings.write_filter(names, out)
    assert bits == 1 << 24
    field = substrings._filter(out, bits)
    name = names.toPandas()["name"].to_numpy().view(np.uint64)
    assert substrings._passes(field, bits, name).all()
    assert substrings._passes(field, bits, np.random.default_rng(1).integers(0, 1 << 64, 100_000, np.uint64)).mean() < 0.02
