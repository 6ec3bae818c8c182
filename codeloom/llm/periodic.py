"""Periodic runs of words: where a stretch repeats itself many times in a row, and text without them.

A run is a stretch of words with smallest period q that no neighbouring word extends, of LEAST
words and POWER periods at least. Runs are found by Kolpakov's and Kucherov's method: a suffix
automaton gives the Lempel-Ziv factorisation, in which each factor is the longest that stands
earlier, too; Main's algorithm finds the runs that touch a factor's boundary; a run strictly
inside a factor is a copy of one in the factor's earlier place.

What cannot be in a run is left out before, with no loss: every window of GRAM words of a run
stands again one period before or after it, inside the run. So a window without an equal one at a
quarter of its stretch's length or less breaks the stretch, and only stretches that are left are
factorised. Windows are compared by hashes there; the method itself compares words.

Edge cases: null and empty texts and texts of white space have no words and no runs, their
collapsed text is empty; runs of one length give the one that starts first, then the one of the
smallest period; rows that repeat are answered each; an empty table gives an empty result; columns
not named are ignored. A text of any length is held as numbers, its words are listed in pieces.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_sizes, map_batches, pieces, rows_out

#: Words and periods that a run has at least.
LEAST, POWER = 6, 4
#: Words of a window: each run has at least so many words but its first period's.
GRAM = min(max(LEAST - q, (POWER - 1) * q) for q in range(1, LEAST + 1))
#: Bytes of texts worked on at once, of a text whose words are listed at once, of words remembered.
CHUNK, LISTED, REMEMBERED = 1 << 19, 1 << 20, 1 << 23

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_FACTORS = (np.arange(5, 5 + GRAM + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


class Words(dict):
    """Numbers of words, in the order of their first places, and the words by number."""

    def __init__(self):
        super().__init__()
        self.names: list[bytes] = []
        self.bytes = 0

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.names)
        self.names.append(word)
        self.bytes += len(word)
        return n

    def of(self, text: str | None) -> np.ndarray:
        data, out, at = (text or "").encode(), [np.zeros(0, np.int32)], 0
        while at < len(data):
            cut = _SPACE.search(data, at + LISTED)
            end = cut.start() if cut else len(data)
            words = data[at:end].split()
            out.append(np.fromiter(map(self.__getitem__, words), np.int32, len(words)))
            at = end
        return np.concatenate(out)


def stretches(texts: list[np.ndarray]) -> Iterator[tuple[int, int, int]]:
    """(text, first word, end) of what may hold runs; no run reaches out of its stretch."""
    sizes = np.array([len(x) for x in texts])
    ends = np.cumsum(sizes)
    words = np.concatenate([np.zeros(0, np.int32), *texts])
    n = len(words) - GRAM + 1
    if n <= 0:
        return
    of = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    h = of[:n].astype(np.uint64) * _FACTORS[GRAM]
    for k in range(GRAM):
        h += (words[k : k + n].astype(np.uint64) + np.uint64(1)) * _FACTORS[k]
        h ^= h >> np.uint64(29)
    # windows over the end of a text are alone; they break stretches
    whole = np.flatnonzero(of[:n] == of[GRAM - 1 :])
    h = h[whole]
    order = np.argsort(h, kind="stable")
    equal = h[order[1:]] == h[order[:-1]]
    del h
    at = whole[order]
    gap = np.diff(at)[equal]
    near = np.full(n, n, np.int64)
    near[at[1:][equal]] = gap
    near[at[:-1][equal]] = np.minimum(near[at[:-1][equal]], gap)
    on = np.flatnonzero(near < n)
    while True:
        if not len(on):
            return
        first = np.flatnonzero(np.diff(on, prepend=-2) > 1)
        size = np.diff(first, append=len(on))
        stay = near[on] <= np.repeat((size + GRAM - 1) // POWER, size)
        if stay.all():
            break
        on = on[stay]
    for i, m in zip(on[first].tolist(), size.tolist(), strict=True):
        if m + GRAM - 1 >= LEAST:
            text = int(np.searchsorted(ends, i, "right"))
            base = int(ends[text] - sizes[text])
            yield text, i - base, i - base + m + GRAM - 1


def factors(w: list[int]) -> list[tuple[int, int]]:
    """(start, start of an earlier place, or -1 for a new word) of the Lempel-Ziv factors.

    States of the suffix automaton are numbers in flat arrays, with one way each there; states
    with more ways have them in a dictionary.
    """
    length, link, end, word, way = array("i", [0]), array("i", [-1]), array("i", [-1]), array("i", [-1]), array("i", [0])
    more: dict[int, dict[int, int]] = {}

    def state(n: int, e: int) -> int:
        length.append(n)
        link.append(0)
        end.append(e)
        word.append(-1)
        way.append(0)
        return len(length) - 1

    def step(s: int, c: int) -> int:
        if word[s] == c:
            return way[s]
        ways = more.get(s)
        return ways.get(c, -1) if ways else -1

    def turn(s: int, c: int, to: int) -> None:
        if word[s] == c or word[s] < 0:
            word[s], way[s] = c, to
        else:
            more.setdefault(s, {})[c] = to

    last = 0
    for i, c in enumerate(w):
        new = state(i + 1, i)
        p = last
        q = -1
        while p >= 0:
            q = step(p, c)
            if q >= 0:
                break
            turn(p, c, new)
            p = link[p]
        if p >= 0:
            if length[p] + 1 != length[q]:
                copy = state(length[p] + 1, end[q])
                link[copy], word[copy], way[copy] = link[q], word[q], way[q]
                if q in more:
                    more[copy] = dict(more[q])
                while p >= 0 and step(p, c) == q:
                    turn(p, c, copy)
                    p = link[p]
                link[q] = copy
                q = copy
            link[new] = q
        last = new
    out, i, n = [], 0, len(w)
    while i < n:
        s, j = 0, i
        while j < n:
            t = step(s, w[j])
            if end[t] >= j:
                break
            s, j = t, j + 1
        out.append((i, end[s] - (j - i) + 1 if j > i else -1))
        i = max(j, i + 1)
    return out


def z_values(s: list[int]) -> list[int]:
    """For each place how many words from there on are those from the beginning on."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        left, right = i, i + k
    return z


def touching(w: list[int], starts: list[int]) -> dict[tuple[int, int], int]:
    """{(first, end): period} of the runs that touch a boundary of factors (Main).

    A run is looked for at the last boundary a that it touches, so that it ends inside the factor
    behind a. Each factor is the longest that stands earlier, so a run cannot reach far to the left of the
    factor before a, or, if it ends at a, of the two before.
    """
    n, out = len(w), {}
    bounds = [*starts, n]
    for k in range(1, len(bounds)):
        a, b = bounds[k], bounds[min(k + 1, len(bounds) - 1)]
        one, two, m = a - bounds[k - 1], bounds[k - 1] - bounds[max(k - 2, 0)], b - a
        if max(4 * (one + two) // 3 + 1, one + 2 * m) < LEAST:
            continue
        low = max(0, a - 2 * (one + two) - m - 1)
        x, y = w[low:a], w[a:b]
        ahead = z_values([*y, -1, *x, *y])
        back = x[::-1]
        behind = z_values([*back, -1, *y[::-1], *back])
        most = (a - low + m) // POWER
        for q in range(1, most + 1):
            if q <= len(x):
                # a period to the left of a is in the run
                right = ahead[m + 1 + len(x) - q] if m else 0
                first, end = a - q - (behind[q] if q < len(x) else 0), a + right
                if end - first >= max(LEAST, POWER * q) and (right < m or not m) and (first > low or not low):
                    out.setdefault((first, end), q)
            if q < m:
                # a period to the right of a is in the run
                first, end = a - behind[len(x) + 1 + m - q], a + q + ahead[q]
                if end - first >= max(LEAST, POWER * q) and end < b and (first > low or not low):
                    out.setdefault((first, end), q)
    return out


def runs(w: list[int]) -> list[tuple[int, int, int]]:
    """(first, end, period) of all runs of a list of word numbers, in order."""
    if len(w) < LEAST:
        return []
    cut = factors(w)
    found = touching(w, [i for i, _ in cut])
    by_first: dict[int, list[tuple[int, int]]] = {}
    for (first, end), q in found.items():
        by_first.setdefault(first, []).append((end, q))
    for k, (start, earlier) in enumerate(cut):
        end = cut[k + 1][0] if k + 1 < len(cut) else len(w)
        shift = start - earlier
        if earlier < 0 or end - start < LEAST + 2:
            continue
        # left to right, so that runs copied by this factor are there when its earlier place overlaps it
        for i in range(earlier + 1, end - shift):
            for e, q in by_first.get(i, ()):
                if e < end - shift and (i + shift, e + shift) not in found:
                    found[i + shift, e + shift] = q
                    by_first.setdefault(i + shift, []).append((e + shift, q))
    return sorted((first, end, q) for (first, end), q in found.items())


def repeated(w: np.ndarray, doc_id: int | None) -> np.ndarray:
    """Words with a tail that repeats, in a tenth of the documents, by the hash of the id."""
    h = zlib.crc32(str(doc_id).encode())
    n = len(w)
    if doc_id is None or h % 10 or not n:
        return w
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([w[:a], np.resize(w[a : a + p], n - a)])


def found_runs(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """The runs (first, end, period) of each text, by start, then period."""
    out = [[] for _ in texts]
    for text, first, end in stretches(texts):
        out[text] += [(first + i, first + j, q) for i, j, q in runs(texts[text][first:end].tolist())]
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in out]


def collapsed(w: np.ndarray, own: list[tuple[int, int, int]]) -> np.ndarray:
    """The words that no run has after its first period."""
    keep = np.ones(len(w), bool)
    for first, end, q in own:
        keep[first + q : end] = False
    return w[keep]


_FIELDS = [("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]
_WHOLE = [*_FIELDS, ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string())]
DIGEST = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repeat_tails: bool = False, with_text: bool = True) -> DataFrame:
    """One row a document: doc_id, n_runs, its greatest run (start, length, period,
    exponent_milli; nulls without one), hashes of all runs and of the collapsed text and, unless
    ``with_text`` is off, the runs and that text.

    ``repeat_tails`` first makes the tail of a tenth of the documents periodic (``repeated``).
    """
    schema = pa.schema(_WHOLE if with_text else _FIELDS)

    def run(batches):
        known = Words()
        for batch in batches:
            texts, ids = batch.column("text"), batch.column("id").to_pylist()
            for i, j in pieces(byte_sizes(texts), CHUNK):
                if known.bytes > REMEMBERED:
                    known = Words()
                words = [known.of(x) for x in texts.slice(i, j - i).to_pylist()]
                if repeat_tails:
                    words = [repeated(w, x) for w, x in zip(words, ids[i:j], strict=True)]
                out = {x.name: [] for x in schema}
                for doc_id, w, own in zip(ids[i:j], words, found_runs(words), strict=True):
                    best = max(own, key=lambda r: (r[1] - r[0], -r[0], -r[2]), default=None)
                    start, length, q = (best[0], best[1] - best[0], best[2]) if best else (None,) * 3
                    told = "".join(f"{a},{b - a},{p}\n" for a, b, p in own)
                    text = b" ".join(map(known.names.__getitem__, collapsed(w, own).tolist()))
                    row = (doc_id, len(own), start, length, q, 1000 * length // q if best else None, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(text).hexdigest())
                    if with_text:
                        row = (*row, [{"start": a, "length": b - a, "period": p} for a, b, p in own], text.decode())
                    for name, value in zip(out, row, strict=True):
                        out[name].append(value)
                yield rows_out(out, schema)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    whole = f"{DIGEST}, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return map_batches(rows, run, whole if with_text else DIGEST)
