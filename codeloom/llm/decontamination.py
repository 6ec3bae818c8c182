"""Benchmark decontamination by spaced-seed hashing.

Words are lower-cased (A-Z) and cut at ASCII white space. Fixed masks over a window of words pick
the positions that count; hashes of the picked words of all benchmark windows are joined with
those of all document windows, so a substituted word at an ignored position changes nothing. Each
hit is verified on its diagonal: a stretch of it must have enough equal words and few
substitutions, and the one with the most equal words counts.

The benchmark index has a stated size bound; a larger benchmark is cut into blocks by item, and
each block is a pass over the documents. Documents are never exchanged.

Edge cases: null and empty texts match nothing; items with fewer words than the window are found
as whole equal sequences, those of one word too, wherever they stand; null ids are carried as null;
repeated rows give their matches again; empty tables give an empty result; other columns are
ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, map_batches, read_bytes, rows_out, work_path, write_bytes

#: Masks over a window: 1 counts, 0 is ignored. The last leaves nothing out: LEAST_WORDS equal words
#: with a share of LEAST_SHARE stand in at most a quarter as many runs and one, so that one run has
#: four words or more.
MASKS = ("110111010011", "101101110101", "111001011101", "1111")
SPAN = len(MASKS[0])
#: A verified overlap has so many equal words (or the whole item), and this share of equal words.
LEAST_WORDS, LEAST_SHARE = 13, 0.8
#: Words of benchmark items in one block of the index (about 100 bytes each in memory).
BLOCK_WORDS = 1_000_000

MATCH = "doc_id long, item_id long, n_equal long, n_aligned long, item_words long, doc_word long"
_MATCH = pa.schema([(x, pa.int64()) for x in ("doc_id", "item_id", "n_equal", "n_aligned", "item_words", "doc_word")])
_FACTORS = (np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


class WordHashes(dict):
    """Hash of each word; short words are remembered, up to about 25 MB."""

    MOST, LONGEST = 150_000, 64

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= self.LONGEST:
            if len(self) >= self.MOST:
                self.clear()
            self[word] = h
        return h


#: Bytes of a text whose words are listed at once.
LISTED = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_hashes(text: str | None, known: WordHashes) -> np.ndarray:
    data = (text or "").encode().lower()
    out, at = [np.zeros(0, np.uint64)], 0
    while at < len(data):
        cut = _SPACE.search(data, at + LISTED)
        end = cut.start() if cut else len(data)
        words = data[at:end].split()
        out.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
        at = end
    return np.concatenate(out)


def masked(h: np.ndarray, mask: str) -> np.ndarray:
    """Hash of each window, of the words that the mask picks."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k, x in enumerate(mask):
        if x == "1":
            out += h[k : k + n] * _FACTORS[k]
    return out ^ (out >> np.uint64(29))


def qualifying(same: np.ndarray) -> tuple[int, int]:
    """First and last place of the stretch with the most equal words among those with LEAST_SHARE of
    them; (0, -1) if no word is equal."""
    equal = np.concatenate(([0], np.cumsum(same)))
    # equal words above the share up to each place; the longest stretch to an end has the most
    above = np.round((equal - LEAST_SHARE * np.arange(len(equal))) * 1000).astype(np.int64)
    start = np.searchsorted(-np.minimum.accumulate(above), -above, "left")
    end = int(np.argmax(equal - equal[start]))
    at = np.flatnonzero(same[start[end] : end])
    return (int(start[end] + at[0]), int(start[end] + at[-1])) if len(at) else (0, -1)


class Index:
    """Hashes of all benchmark windows, sorted, with a bitmap before them."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.ids = [x for x, _ in items]
        self.words = [h for _, h in items]
        masks = [*MASKS, *sorted({"1" * len(h) for h in self.words if 0 < len(h) < SPAN} - {*MASKS})]
        self.tables = []
        for mask in masks:
            use = [(k, h) for k, h in enumerate(self.words) if (len(h) == len(mask) or (len(h) >= SPAN and mask in MASKS))]
            found = [(masked(h, mask), k) for k, h in use]
            key = np.concatenate([np.zeros(0, np.uint64), *[x for x, _ in found]])
            item = np.concatenate([np.zeros(0, np.int64), *[np.full(len(x), k) for x, k in found]]).astype(np.int64)
            at = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(x)) for x, _ in found]]).astype(np.int64)
            order = np.argsort(key, kind="stable")
            bits = np.zeros(1 << 22, bool)
            bits[(key >> np.uint64(42)).astype(np.int64)] = True
            self.tables.append((mask, key[order], item[order], at[order], bits))

    def hits(self, h: np.ndarray) -> np.ndarray:
        """(item, diagonal) of windows in common, each once, as rows in order."""
        found = [np.zeros((0, 2), np.int64)]
        for mask, key, item, at, bits in self.tables:
            q = masked(h, mask)
            maybe = np.flatnonzero(bits[(q >> np.uint64(42)).astype(np.int64)])
            if not len(maybe):
                continue
            q = q[maybe]
            lo, hi = np.searchsorted(key, q, "left"), np.searchsorted(key, q, "right")
            n = hi - lo
            j = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - lo, n)
            found.append(np.unique(np.column_stack((item[j], np.repeat(maybe, n) - at[j])), axis=0))
        return np.unique(np.concatenate(found), axis=0)

    def matches(self, h: np.ndarray) -> dict[int, tuple[int, int, int]]:
        """For each item with a verified overlap: equal words, aligned words, place in the document."""
        best: dict[int, tuple[int, int, int]] = {}
        for k, d in self.hits(h).tolist():
            w = self.words[k]
            lo, hi = max(0, d), min(len(h), d + len(w))
            same = h[lo:hi] == w[lo - d : hi - d]
            least = max(min(LEAST_WORDS, len(w)), best.get(k, (0,))[0] + 1)
            if int(same.sum()) < least:
                continue
            start, end = qualifying(same)
            equal = int(same[start : end + 1].sum())
            if equal >= least and equal >= LEAST_SHARE * (end - start + 1):
                best[k] = (equal, end - start + 1, lo + start)
        return best


def build_indexes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> list[str]:
    """Write the benchmark's blocks to the shared folder; each block is bounded by BLOCK_WORDS."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    words = items.agg(F.coalesce(F.sum(F.length("t") / 4), F.lit(0))).first()[0]
    blocks = int(words // BLOCK_WORDS) + 1
    out = []
    for b in range(blocks):
        table = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).orderBy("i", "t").toArrow()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as w:
            w.write_table(table)
        uri = work_path(spark, "benchmark") + "/block.arrow"
        write_bytes(uri, sink.getvalue().to_pybytes())
        out.append(uri)
    return out


@lru_cache(maxsize=2)
def _index(uri: str) -> tuple[Index, WordHashes]:
    table, known = pa.ipc.open_stream(read_bytes(uri)).read_all(), WordHashes()
    ids, texts = table["i"].to_pylist(), table["t"].to_pylist()
    return Index([(i, word_hashes(t, known)) for i, t in zip(ids, texts, strict=True)]), known


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Verified overlaps, one row for each document and item that have one."""
    uris = build_indexes(benchmark)

    def run(uri):
        def f(batches):
            index, known = _index(uri)
            for batch in batches:
                out = []
                for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    for k, (equal, n, at) in sorted(index.matches(word_hashes(text, known)).items()):
                        out.append((i, index.ids[k], equal, n, len(index.words[k]), at))
                columns = zip(*out, strict=True) if out else [[]] * len(_MATCH)
                yield rows_out(dict(zip(_MATCH.names, columns, strict=True)), _MATCH)

        return f

    rows, found = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), None
    for uri in uris:
        part = map_batches(rows, run(uri), MATCH)
        found = part if found is None else found.unionByName(part)
    return found


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a verified overlap, unchanged; no exchange."""
    bound_batches(docs.sparkSession)
    for uri in build_indexes(benchmark):

        def test(texts: pa.Array, uri=uri) -> pa.Array:
            index, known = _index(uri)
            return pa.array([not index.matches(word_hashes(x, known)) for x in texts.to_pylist()], pa.bool_())

        docs = docs.where(F.arrow_udf(_typed(test), "boolean")("text"))
    return docs


def _typed(f):
    def clean(texts: pa.Array) -> pa.Array:
        return f(texts)

    return clean
