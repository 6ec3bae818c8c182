"""Exact substring removal with suffix arrays.

A byte is removed if it is covered by a string of LENGTH bytes that also starts earlier (in a
smaller document, or before in the same one).

Candidates. Every start of LENGTH bytes is named by the smallest of the GRAM-byte strings inside, in
an order by 32-bit hashes; the name is a 64-bit hash of that string (of several with one order hash,
the smallest name): equal strings have equal names wherever they stand. Neighbouring starts of one
name form a segment. Names are counted; a Bloom filter of bounded size (when it is full it only lets more
through) keeps the segments whose name occurs again. Equal segments are then one row with its
first place: all other occurrences are repeats.

Shards. The different segments are dealt out by name. In each shard, starts whose LENGTH bytes have
a 64-bit hash that no other start has cannot be repeats and are left out with no loss. The others
get a suffix array by Larsson-Sadakane refinement (8 bytes first, then doubling, sorting only groups
not yet apart, to LENGTH bytes); starts of one rank are the same string, and all but its first place
are repeats. Names with very many segments are split
over several shards; the sorted strings that each of those leaves are exchanged by range and merged
by binary search (there, two independent 64-bit hashes stand for the strings).

Edge cases: null text is empty; texts under LENGTH bytes lose nothing; rows that repeat both id
and text are one document and keep the same bytes; of different texts with one id, the one with
the smaller hash is the earlier; null ids come first; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, filesystem, map_batches, partitions, pieces, read_bytes, rows_out, stored, work_path

LENGTH, GRAM = 100, 24
WINDOW = LENGTH - GRAM + 1
#: Bytes of text worked on at once (few, so that arrays stay in a core's cache); bits of the Bloom filter for each
#: name, and at most.
CHUNK, BITS, MOST_BITS = 1 << 16, 16, 1 << 29
#: Bytes of segments in one suffix array.
SHARD_BYTES = 1 << 21

#: A table of bytes and multipliers for each of two independent hashes.
_BYTE = [np.random.default_rng(k).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1) for k in (5, 15)]
_ODD = [np.random.default_rng(k).integers(0, 1 << 63, 16, np.uint64) * np.uint64(2) + np.uint64(1) for k in (6, 16)]
_BYTE32, _ODD32 = ((x >> np.uint64(31)).astype(np.uint32) | np.uint32(1) for x in (_BYTE[0], _ODD[0]))


def _joined(one: np.ndarray, two: np.ndarray, gap: int, factor: np.uint64) -> np.ndarray:
    n = min(len(one), len(two) - gap)
    x = one[:n] * factor
    x += two[gap : gap + n]
    return x


def string_hashes(data: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hash of every string of GRAM bytes; that of salt 1 is independent of that of salt 0."""
    odd = _ODD[salt]
    h1 = _BYTE[salt][data]
    h2 = _joined(h1, h1, 1, odd[0])
    h4 = _joined(h2, h2, 2, odd[1])
    h8 = _joined(h4, h4, 4, odd[2])
    h16 = _joined(h8, h8, 8, odd[3])
    x = _joined(h16, h8, 16, odd[4])
    x ^= x >> np.uint64(31)
    x *= odd[5]
    x ^= x >> np.uint64(29)
    return x


def long_hashes(data: np.ndarray, at: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hash of the LENGTH bytes at each of ``at``."""
    h, odd = string_hashes(data, salt), _ODD[salt][8]
    x = np.zeros(len(at), np.uint64)
    for k in range(0, LENGTH - GRAM + 1, 19):  # strings of GRAM bytes that cover LENGTH
        x = (x ^ (x >> np.uint64(32))) * odd + h[at + k]
    return x ^ (x >> np.uint64(29))


def string_orders(data: np.ndarray) -> np.ndarray:
    """A number of 32 bits for every string of GRAM bytes; it orders them and need not tell them apart."""
    odd = _ODD32
    h2 = _joined(h1 := _BYTE32[data], h1, 1, odd[0])
    h4 = _joined(h2, h2, 2, odd[1])
    h8 = _joined(h4, h4, 4, odd[2])
    x = _joined(_joined(h8, h8, 8, odd[3]), h8, 16, odd[4])
    x ^= x >> np.uint32(15)
    x *= odd[5]
    x ^= x >> np.uint32(14)
    return x


def string_names(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit hash of the GRAM bytes at each of ``at``."""
    words = np.lib.stride_tricks.sliding_window_view(data, GRAM)[at].view("<u8")
    x = np.zeros(len(at), np.uint64)
    for k in range(words.shape[1]):
        x = (x ^ (x >> np.uint64(32)) ^ words[:, k]) * _ODD[0][9 + k]
    x ^= x >> np.uint64(31)
    x *= _ODD[0][12]
    return x ^ (x >> np.uint64(29))


def _windows(x: np.ndarray, best: np.ufunc) -> np.ndarray:
    width = 1
    while 2 * width <= WINDOW:
        x = best(x[:-width], x[width:])
        width *= 2
    rest = WINDOW - width
    return best(x[:-rest], x[rest:]) if rest else x


def window_minima(x: np.ndarray) -> np.ndarray:
    """Smallest of each WINDOW neighbouring values."""
    return _windows(x, np.minimum)


def segments(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Segments of joined texts: name, text, first start (in the joined bytes), starts, and whether
    the naming string stands in it more than once."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none.astype(np.uint64), none, none, none, none.astype(bool)
    x = string_orders(data)
    m = window_minima(x)
    ends = np.cumsum(sizes)
    new = np.append(True, m[1:] != m[:-1])
    new[(ends - sizes)[sizes >= LENGTH]] = True
    at = np.flatnonzero(new)
    text = np.searchsorted(ends, at, "right")
    fits = at + LENGTH <= ends[text]
    at, text = at[fits], text[fits]
    if not len(at):
        return none.astype(np.uint64), none, none, none, none.astype(bool)
    # a segment ends before the next one, or where its text's starts end
    last = np.minimum(np.append(at[1:], len(m)), ends[text] - LENGTH + 1)
    n = last - at
    # strings that are the smallest of a window, and those of each segment that are the smallest there
    edge = np.zeros(WINDOW - 1, np.uint32)
    least = np.flatnonzero(x == _windows(np.concatenate((edge, m, edge)), np.maximum))
    names = string_names(data, least)
    begin = np.searchsorted(least, at)
    many = np.searchsorted(least, last + WINDOW - 1) - begin
    cut = np.cumsum(many) - many
    index = np.arange(int(many.sum())) - np.repeat(cut - begin, many)
    mine = x[least[index]] == np.repeat(m[at], many)
    twice = np.add.reduceat(mine, cut, dtype=np.int64) > 1
    name = np.minimum.reduceat(np.where(mine, names[index], np.uint64(2**64 - 1)), cut)
    mixed = np.flatnonzero(np.maximum.reduceat(np.where(mine, names[index], np.uint64(0)), cut) != name)
    if not len(mixed):
        return name, text, at, n, twice
    # different strings of one order in a segment, which is rare: its starts are named one by one
    keep = np.ones(len(at), bool)
    keep[mixed] = False
    parts = [tuple(x[keep] for x in (name, text, at, n, twice))]
    for k in mixed.tolist():
        own = index[cut[k] : cut[k] + many[k]][mine[cut[k] : cut[k] + many[k]]]
        smallest = np.full(n[k] + WINDOW - 1, 2**64 - 1, np.uint64)
        smallest[least[own] - at[k]] = names[own]
        each = window_minima(smallest)
        first = np.flatnonzero(np.append(True, each[1:] != each[:-1]))
        parts.append((each[first], np.full(len(first), text[k]), at[k] + first, np.diff(first, append=n[k]), np.ones(len(first), bool)))
    name, text, at, n, twice = (np.concatenate(x) for x in zip(*parts, strict=True))
    by = np.argsort(at)
    return name[by], text[by], at[by], n[by], twice[by]


def _pieces(batch) -> list:
    """Rows of a batch in pieces of about CHUNK bytes: rows, joined bytes, bytes of each."""
    texts = pc.fill_null(batch.column("text"), "").cast(pa.large_string())
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data or b"", np.uint8)
    return [(range(i, k), data[ends[i] : ends[k]], np.diff(ends[i : k + 1])) for i, k in pieces(np.diff(ends).tolist(), CHUNK)]


def name_counts(rows: DataFrame) -> DataFrame:
    """Names that occur more than once, in different segments or within one."""

    def run(batches):
        for batch in batches:
            found = [segments(data, sizes) for _, data, sizes in _pieces(batch)]
            if not found:
                continue
            name, twice = (np.concatenate([x[k] for x in found]) for k in (0, 4))
            name, inverse = np.unique(name, return_inverse=True)
            n = np.bincount(inverse, 1.0 + twice, len(name)).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"name": pa.array(name.view(np.int64)), "n": pa.array(n)})

    return map_batches(rows.select("text"), run, "name long, n int").groupBy("name").agg(F.sum("n").alias("n")).where("n > 1").select("name")


def _bits_of(name: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = name * _ODD[0][6], name * _ODD[0][7]
    a ^= a >> np.uint64(32)
    b ^= b >> np.uint64(33)
    return a & np.uint64(bits - 1), b & np.uint64(bits - 1)


def write_filter(names: DataFrame, out: str) -> int:
    """A Bloom filter of ``names`` as one file a block of bits; returns its number of bits."""
    spark = names.sparkSession
    bits = 1 << min(int(math.log2(MOST_BITS)), max(16, math.ceil(math.log2(max(1, names.count()) * BITS))))
    block = min(bits, 1 << 23)

    def split(batches):
        def rows(held):
            places = np.unique(np.concatenate(_bits_of(np.concatenate(held).view(np.uint64), bits)).astype(np.int64))
            k, first = np.unique(places // block, return_index=True)
            parts = [x.astype("<i4").tobytes() for x in np.split(places % block, first[1:])]
            return pa.RecordBatch.from_pydict({"block": pa.array(k.astype(np.int32)), "places": pa.array(parts, pa.binary())})

        held = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch.column("name").to_numpy())
            if len(held) >= 512:
                yield rows(held)
                held = []
        if held:
            yield rows(held)

    def write(batches):
        field = {}
        for batch in batches:
            for b, places in zip(batch.column("block").to_pylist(), batch.column("places").to_pylist(), strict=True):
                field.setdefault(b, np.zeros(block, bool))[np.frombuffer(places, "<i4")] = True
        for b, x in field.items():
            files, path = filesystem(f"{out}/block-{b}")
            files.create_dir(path.rpartition("/")[0], recursive=True)
            new = f"{path}.new-{uuid.uuid4().hex}"
            with files.open_output_stream(new) as f:
                f.write(np.packbits(x).tobytes())
            files.move(new, path)
            yield pa.RecordBatch.from_pydict({"block": pa.array([b], pa.int32())})

    # a row has the bits of many names
    spread = map_batches(names, split, "block int, places binary").repartition(min(bits // block, partitions(spark)), "block")
    map_batches(spread, write, "block int").count()
    return bits


@lru_cache(maxsize=1)
def _filter(out: str, bits: int) -> np.ndarray:
    from pyarrow.fs import FileType

    block = min(bits, 1 << 23)
    field = np.zeros(bits // 8, np.uint8)
    for b in range(bits // block):
        files, path = filesystem(f"{out}/block-{b}")
        if files.get_file_info(path).type == FileType.File:
            field[b * block // 8 : (b + 1) * block // 8] = np.frombuffer(read_bytes(f"{out}/block-{b}"), np.uint8)
    return field


def _passes(field: np.ndarray, bits: int, name: np.ndarray) -> np.ndarray:
    ok = np.ones(len(name), bool)
    for x in _bits_of(name, bits):
        ok &= (field[(x >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (x & np.uint64(7))).astype(np.uint8)) & 1 > 0
    return ok


_SEGMENT = pa.schema([("name", pa.int64()), ("sid", pa.binary()), ("doc_id", pa.int64()), ("h", pa.int64()), ("start", pa.int64()), ("n", pa.int32()), ("twice", pa.bool_()), ("bytes", pa.binary())])


def kept_segments(rows: DataFrame, out: str, bits: int) -> DataFrame:
    """Segments whose name may occur again, with their bytes."""

    def run(batches):
        import xxhash

        field = _filter(out, bits)
        for batch in batches:
            ids, hashes = batch.column("doc_id"), batch.column("h")
            for where, data, sizes in _pieces(batch):
                name, text, at, n, twice = segments(data, sizes)
                ok = _passes(field, bits, name)
                name, text, at, n, twice = name[ok], text[ok], at[ok], n[ok], twice[ok]
                raw = data.tobytes()
                parts = [raw[a : a + k + LENGTH - 1] for a, k in zip(at.tolist(), n.tolist(), strict=True)]
                row = pa.array(np.array(where)[text])
                begin = np.cumsum(sizes) - sizes
                yield rows_out({"name": name.view(np.int64), "sid": [xxhash.xxh3_128_digest(x) for x in parts], "doc_id": ids.take(row), "h": hashes.take(row), "start": at - begin[text], "n": n.astype(np.int32), "twice": twice, "bytes": parts}, _SEGMENT)

    return map_batches(rows, run, "name long, sid binary, doc_id long, h long, start long, n int, twice boolean, bytes binary")


def suffix_ranks(data: np.ndarray) -> np.ndarray:
    """For each place, how many have smaller LENGTH bytes: Larsson-Sadakane refinement, cut at LENGTH.

    All places get a rank by 8 bytes; each round doubles the depth by the rank of the place that
    many bytes on, and sorts only places whose group is not yet a single one.
    """
    n = len(data)
    padded = np.concatenate((data, np.zeros(LENGTH, np.uint8))).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k : k + n]
    order = np.argsort(key)
    first = np.ones(n, bool)
    first[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.empty(n + LENGTH, np.int64)
    rank[n:] = -1
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    for step in (8, 16, 32, LENGTH - 64):
        alone = first & np.append(first[1:], True)
        where = np.flatnonzero(~alone)
        if not len(where):
            break
        places = order[where]
        key = rank[places] * (n + 1) + rank[places + step] + 1  # by group, and by what follows
        by = np.argsort(key)
        places, key = places[by], key[by]
        order[where] = places
        differs = np.ones(len(where), bool)
        differs[1:] = key[1:] != key[:-1]
        first[where] = differs
        rank[places] = where[np.maximum.accumulate(np.where(differs, np.arange(len(where)), 0))]
    return rank[:n]


def suffix_order(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The starts in the order of their LENGTH bytes; equal ones in the order of the text."""
    n = max(1, len(data))
    return np.sort(suffix_ranks(data)[starts] * n + starts) % n


def common_prefixes(data: np.ndarray, order: np.ndarray, seg_at: np.ndarray, seg_n: np.ndarray) -> np.ndarray:
    """Bytes (up to LENGTH) that each start in ``order`` shares with the one before it.

    Kasai's argument, for all segments in step: where the start before had l common bytes with its
    predecessor j, this one has l - 1 at least, provided that j + 1 is a start too. Equal strings
    keep no such order, so after LENGTH common bytes it holds only if j + 1 is the predecessor.
    """
    size = int(data.size)
    before = np.full(size + 1, -1, np.int64)
    before[order[1:]] = order[:-1]
    is_start = np.zeros(size + 1, bool)
    is_start[order] = True
    lcp = np.zeros(size + 1, np.int64)
    active = np.arange(len(seg_at))
    step = 0
    while len(active):
        i = seg_at[active] + step
        j = before[i]
        had, back = (lcp[i - 1], before[i - 1]) if step else (np.zeros(len(i), np.int64), np.full(len(i), -1))
        safe = (had > 0) & (back >= 0) & is_start[back + 1] & ((had < LENGTH) | (j == back + 1))
        l = np.where(safe, had - 1, 0)  # noqa: E741
        l[j < 0] = 0
        more = np.flatnonzero(j >= 0)
        while len(more):
            same = data[i[more] + l[more]] == data[j[more] + l[more]]
            more = more[same]
            l[more] += 1
            more = more[l[more] < LENGTH]
        lcp[i] = l
        step += 1
        active = active[seg_n[active] > step]
    return lcp[order]


def repeats(parts: list[bytes], place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all starts of the segments: segment, offset, whether an earlier place has its string.

    ``place`` has a row (document rank, start) for each segment. The last value is the joined bytes'
    index of each start.
    """
    data = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(x) for x in parts], np.int64)
    at, n = np.cumsum(sizes) - sizes, sizes - LENGTH + 1
    seg = np.repeat(np.arange(len(parts)), n)
    offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    starts = at[seg] + offset
    late = np.zeros(len(starts), bool)
    # only starts whose hash occurs again can be repeats; the array is made of the bytes under them
    key = long_hashes(data, starts) if len(starts) else np.zeros(0, np.uint64)
    order = np.argsort(key)
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    again = np.zeros(len(starts), bool)
    again[order[same]] = again[order[same + 1]] = True
    again = np.flatnonzero(again)
    if not len(again):
        return seg, offset, late, starts
    edge = np.zeros(len(data) + 1, np.int32)
    edge[starts[again]] += 1
    edge[starts[again] + LENGTH] -= 1
    under = np.cumsum(edge[:-1]) > 0
    rank = suffix_ranks(data[under])[(np.cumsum(under) - 1)[starts[again]]]
    # starts of one rank have the same bytes; all but the first in place are repeats
    start = place[seg[again], 1] + offset[again]
    age = place[seg[again], 0] * (int(start.max()) + 1) + start
    least = np.full(int(rank.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, rank, age)
    late[again] = age != least[rank]
    return seg, offset, late, starts


def _runs(seg: np.ndarray, offset: np.ndarray, flag: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longest runs of flagged offsets: segment, first, last."""
    at = np.flatnonzero(flag)
    if not len(at):
        return at, at, at
    new = np.ones(len(at), bool)
    new[1:] = (seg[at[1:]] != seg[at[:-1]]) | (offset[at[1:]] != offset[at[:-1]] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return seg[at[first]], offset[at[first]], offset[at[last]]


#: A result of a shard: kind 0 is a run of repeated starts of a document; kind 1 holds strings of
#: a split name, sorted: hashes, documents and starts as arrays, for one range.
_SHARD = "kind int, doc_id long, h long, lo long, hi long, range int, strings binary"
_SHARD_PA = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("h", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("range", pa.int32()), ("strings", pa.binary())])
_STRING = np.dtype([("a", "<u8"), ("b", "<u8"), ("null", "?"), ("doc_id", "<i8"), ("h", "<i8"), ("start", "<i8")])


def _documents(ids: list, hashes: list) -> np.ndarray:
    """Rank of each (id, hash), null ids first."""
    doc = np.array([-(2**63) if x is None else x for x in ids], np.int64)
    has = np.array([x is not None for x in ids])
    key = np.array(hashes, np.int64)
    order = np.lexsort((key, doc, has))
    new = np.ones(len(doc), bool)
    new[1:] = (doc[order[1:]] != doc[order[:-1]]) | (key[order[1:]] != key[order[:-1]]) | (has[order[1:]] != has[order[:-1]])
    rank = np.empty(len(doc), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def _shard(rows: list[dict], ranges: int) -> pa.RecordBatch:
    parts = [r["bytes"] for r in rows]
    place = np.column_stack((_documents([r["doc_id"] for r in rows], [r["h"] for r in rows]), [r["start"] for r in rows]))
    seg, offset, late, at = repeats(parts, place)
    out = {x.name: [] for x in _SHARD_PA}

    def add(*row):
        for k, v in zip(out, row, strict=True):
            out[k].append(v)

    for s, a, b in zip(*(x.tolist() for x in _runs(seg, offset, late)), strict=True):
        add(0, rows[s]["doc_id"], rows[s]["h"], rows[s]["start"] + a, rows[s]["start"] + b, None, None)
    split = np.array([r["split"] for r in rows])
    left = np.flatnonzero(split[seg] & ~late)
    if len(left):
        data = np.frombuffer(b"".join(parts), np.uint8)
        strings = np.zeros(len(left), _STRING)
        for key, salt in (("a", 0), ("b", 1)):
            strings[key] = long_hashes(data, at[left], salt)
        for k, of in (("doc_id", "doc_id"), ("h", "h")):
            strings[k] = np.array([r[of] or 0 for r in rows], np.int64)[seg[left]]
        strings["null"] = np.array([r["doc_id"] is None for r in rows])[seg[left]]
        strings["start"] = np.array([r["start"] for r in rows], np.int64)[seg[left]] + offset[left]
        strings.sort(order=("a", "b"))
        # ranges of the sorted strings, cut by binary search
        edges = (np.arange(1, ranges, dtype=np.float64) * (2.0**64 / ranges)).astype(np.uint64)
        cut = np.concatenate(([0], np.searchsorted(strings["a"], edges), [len(strings)])).tolist()
        for k in range(ranges):
            if cut[k] < cut[k + 1]:
                add(1, None, None, None, None, k, strings[cut[k] : cut[k + 1]].tobytes())
    return rows_out(out, _SHARD_PA)


def _merged(rows: list[bytes]) -> pa.RecordBatch:
    """Runs of strings that an earlier place in another shard has: shards' sorted strings are
    searched for each other's, keeping the earliest place of each."""
    rows = [np.frombuffer(x, _STRING) for x in rows]
    every = np.unique(np.concatenate([x[["a", "b"]] for x in rows]))
    age = lambda x: (~x["null"], x["doc_id"], x["h"], x["start"])
    all_rows = np.concatenate(rows)
    at = np.searchsorted(every["a"], all_rows["a"], "left")
    while True:  # strings with one first hash lie side by side
        off = every["b"][at] != all_rows["b"]
        if not off.any():
            break
        at[off] += 1
    order = np.lexsort((*age(all_rows)[::-1], at))
    first = np.ones(len(order), bool)
    first[1:] = at[order[1:]] != at[order[:-1]]
    late = all_rows[order[~first]]
    late = late[np.lexsort(age(late)[::-1])]
    new = np.ones(len(late), bool)
    if len(late):
        new[1:] = (late["doc_id"][1:] != late["doc_id"][:-1]) | (late["h"][1:] != late["h"][:-1]) | (late["null"][1:] != late["null"][:-1]) | (late["start"][1:] != late["start"][:-1] + 1)
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(late)) - 1
    return pa.RecordBatch.from_pydict({"doc_id": pa.array(late["doc_id"][a], mask=late["null"][a]), "h": pa.array(late["h"][a]), "lo": pa.array(late["start"][a]), "hi": pa.array(late["start"][b] if len(late) else a)})


def repeated_runs(rows: DataFrame) -> DataFrame:
    """(doc_id, h, lo, hi): runs of starts whose LENGTH bytes also start earlier."""
    spark = rows.sparkSession
    n_parts = partitions(spark)
    names = stored(name_counts(rows), "names")
    out = work_path(spark, "filter")
    bits = write_filter(names, out)
    found = stored(kept_segments(rows, out, bits), "segments")
    place = F.struct("doc_id", "h", "start")
    firsts = found.groupBy("sid").agg(F.min(place).alias("first"), F.count("*").alias("times"), F.first("name").alias("name"), F.first("twice").alias("twice"), F.first("bytes").alias("bytes"))
    firsts = stored(firsts, "first-segments")
    again = found.select("sid", "doc_id", "h", "start", "n").join(firsts.where("times > 1").select("sid", "first"), "sid")
    copies = again.where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("h") == F.col("first.h")) & (F.col("start") == F.col("first.start"))))
    copies = copies.select("doc_id", "h", F.col("start").alias("lo"), (F.col("start") + F.col("n") - 1).alias("hi"))

    sizes = firsts.groupBy("name").agg(F.count("*").alias("different"), F.max("twice").alias("twice")).where("different > 1 or twice").select("name", "different")
    sizes = stored(sizes, "name-sizes")
    total = sizes.agg(F.coalesce(F.sum("different"), F.lit(0))).first()[0]
    most = max(64, total // (2 * n_parts))
    # at most 2 * n_parts names can have more than that: the list is bounded
    large = {r.name: r.different for r in sizes.where(F.col("different") > most).collect()}
    rows_in = firsts.join(sizes.select("name"), "name").select("name", "sid", F.col("first.doc_id").alias("doc_id"), F.col("first.h").alias("h"), F.col("first.start").alias("start"), "bytes")
    salt, split = F.lit(0), F.lit(False)
    if large:
        table = spark.createDataFrame([(k, -(-v // most)) for k, v in large.items()], "name long, parts int")
        rows_in = rows_in.join(F.broadcast(table), "name", "left")
        split = F.col("parts").isNotNull()
        salt = F.coalesce(F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int"), F.lit(0))
    rows_in = rows_in.select("name", salt.alias("salt"), split.alias("split"), "doc_id", "h", "start", "bytes")
    ranges = max(1, min(n_parts, sum(large.values()) // 2000))

    def shards(batches):
        now, size, last = [], 0, None
        for batch in batches:
            for r in batch.to_pylist():
                key = (r["name"], r["salt"])
                if size >= SHARD_BYTES and key != last:
                    yield _shard(now, ranges)
                    now, size = [], 0
                now.append(r)
                size += len(r["bytes"])
                last = key
        if now:
            yield _shard(now, ranges)

    dealt = rows_in.repartition(n_parts, "name", "salt").sortWithinPartitions("name", "salt")
    result = stored(map_batches(dealt, shards, _SHARD), "shards")
    runs = copies.union(result.where("kind = 0").select("doc_id", "h", "lo", "hi"))
    if large:

        def merge(batches):
            held, last = [], None
            for batch in batches:
                for k, x in zip(batch.column("range").to_pylist(), batch.column("strings").to_pylist(), strict=True):
                    if held and k != last:
                        yield _merged(held)
                        held = []
                    held.append(x)
                    last = k
            if held:
                yield _merged(held)

        strings = result.where("kind = 1").select("range", "strings").repartition(min(ranges, n_parts), "range").sortWithinPartitions("range")
        runs = runs.union(map_batches(strings, merge, "doc_id long, h long, lo long, hi long"))
    runs = stored(runs, "runs")
    discard(spark, names, sizes, found, firsts, result)
    return runs


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = True) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the kept bytes."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).select("doc_id", F.xxhash64("text").alias("h"), "text")
    runs = repeated_runs(rows).groupBy("doc_id", "h").agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("runs"))
    runs = runs.select(F.col("doc_id").alias("d"), F.col("h").alias("k"), F.col("runs.lo").alias("lo"), F.col("runs.hi").alias("hi"))
    both = rows.join(runs, rows.doc_id.eqNullSafe(runs.d) & (rows.h == runs.k), "left").select("doc_id", "text", "lo", "hi")

    def run(batches):
        for batch in batches:
            out = {x.name: [] for x in _KEPT}
            out["doc_id"] = batch.column("doc_id")
            for text, lo, hi in zip(batch.column("text").to_pylist(), batch.column("lo").to_pylist(), batch.column("hi").to_pylist(), strict=True):
                data, spans, kept, at = (text or "").encode(), [], [], 0
                for a, b in zip(lo or [], hi or [], strict=True):
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], b + LENGTH)
                    else:
                        spans.append([a, b + LENGTH])
                for a, b in spans:
                    kept.append(data[at:a])
                    at = b
                kept = b"".join([*kept, data[at:]])
                for k, v in zip(_KEPT.names[1:], (len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept if with_bytes else None), strict=True):
                    out[k].append(v)
            yield rows_out(out, _KEPT)

    return map_batches(both, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
