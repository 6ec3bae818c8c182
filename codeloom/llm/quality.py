"""Quality rules by compression bands.

A text is compressed with zstandard, whole and in fixed chunks of its bytes, the last one aligned
to its end; texts under a few chunks are cut into smaller ones. Too small a ratio of
compressed to plain size means repetition, too large a ratio means noise; the limits depend on
the length, as short texts compress less. The base rules look at words, symbols and repeats.

Edge cases: null and empty texts have no words and fail the base rules; any other column may be
null or clash in name, it is ignored; every input row gives one row.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, map_batches, rows_out

#: The base rules.
SYMBOLS, LEAST_WORDS, MOST_REPEATED = "#*$%&|<>", 50, 50
LEVEL, CHUNK = 3, 4096
#: (bytes up to, smallest ratio, largest ratio) of whole texts; measured on rows labelled good.
BANDS = ((512, 0.30, 0.95), (1024, 0.25, 0.90), (2048, 0.22, 0.80), (4096, 0.20, 0.75), (16384, 0.16, 0.70), (1 << 62, 0.10, 0.70))
#: (bytes up to, bytes of a chunk, smallest ratio, largest ratio): chunks of a text and their limits,
#: between rows labelled good (at most 0.715, 0.603 and 0.482; at least 0.518, 0.496 and 0.443) and
#: spaced base64 noise (at least 0.809, 0.76 and 0.729); the share of chunks that may lie outside.
CHUNK_BANDS, CHUNKS_OUT = ((2048, 512, 0.30, 0.77), (16384, 1024, 0.25, 0.69), (1 << 62, CHUNK, 0.15, 0.62)), 0.2

RULES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, chunks_out double"
_RULES = pa.schema([("doc_id", pa.int64()), *[(x, pa.int64()) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("ratio", pa.float64()), ("chunks_out", pa.float64())])
_SPACES = (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")


@lru_cache(maxsize=4)
def _compressor(level: int):
    import zstandard

    return zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False)


def repeated_words(ids: np.ndarray) -> int:
    """Words in windows of three that occur twice or more; ids are below 2 ** 21."""
    if len(ids) < 4:
        return 0
    three = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
    order = np.argsort(three)
    same = np.diff(three[order]) == 0
    if not same.any():
        return 0
    hit = np.zeros(len(three), bool)
    hit[order[:-1][same]] = True
    hit[order[1:][same]] = True
    covered = np.zeros(len(ids), bool)
    covered[:-2] |= hit
    covered[1:-1] |= hit
    covered[2:] |= hit
    return int(covered.sum())


def duplicate_lines(data: bytes) -> int:
    lines = data.split(b"\n")
    if len(lines) == 1:
        return 0
    lines = [x for x in lines if x.strip(b" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def bands(data: bytes) -> tuple[float, float, bool]:
    """Ratio of the whole, share of chunks outside their band, and the verdict."""
    pack = _compressor(LEVEL).compress
    n = len(data)
    if not n:
        return 0.0, 0.0, False
    ratio = len(pack(data)) / n
    low, high = next(x[1:] for x in BANDS if n <= x[0])
    size, least, most = next(x[1:] for x in CHUNK_BANDS if n <= x[0])
    begins = [*range(0, n - size + 1, size), *([n - size] if n > size and n % size else [])]
    out = sum(not least <= len(pack(data[i : i + size])) / size <= most for i in begins) / len(begins) if begins else 0.0
    return ratio, out, low <= ratio <= high and out <= CHUNKS_OUT


def repeated_wide(ids: np.ndarray) -> int:
    """As ``repeated_words``, for ids of any size: pairs are numbered first."""
    if len(ids) < 4:
        return 0
    _, pair = np.unique(ids[:-1] * (int(ids.max()) + 1) + ids[1:], return_inverse=True)
    _, three, n = np.unique(pair[:-1] * (int(ids.max()) + 1) + ids[2:], return_inverse=True, return_counts=True)
    hit, covered = n[three] > 1, np.zeros(len(ids), bool)
    for k in range(3):
        covered[k : k + len(hit)] |= hit
    return int(covered.sum())


def measures(text: str | None) -> tuple:
    """The columns of a result row after doc_id, for one text."""
    data = (text or "").encode()
    words = data.split()
    n, number = len(words), {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    repeats = repeated_words(ids) if len(number) < 1 << 21 else repeated_wide(ids)
    ratio, out, fits = bands(data)
    failed = n < LEAST_WORDS or 100 * repeats > MOST_REPEATED * n
    symbols = sum(map(data.count, SYMBOLS.encode()))
    return n, len(text or "") - sum(map(data.count, _SPACES)), symbols, duplicate_lines(data), repeats, failed, fits and not failed, ratio, out


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: the base figures, base_failed, kept, and the method's ratios."""

    def run(batches):
        for batch in batches:
            found = [measures(x) for x in batch.column("text").to_pylist()]
            values = zip(*found, strict=True) if found else [[]] * (len(_RULES) - 1)
            yield rows_out({"doc_id": batch.column("id"), **dict(zip(_RULES.names[1:], values, strict=True))}, _RULES)

    return map_batches(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), run, RULES)


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, unchanged: one Arrow pass over the texts, no exchange."""

    @F.arrow_udf("boolean")
    def passes(texts: pa.Array) -> pa.Array:
        return pa.array([measures(x)[6] for x in texts.to_pylist()], pa.bool_())

    bound_batches(docs.sparkSession)
    return docs.where(passes("text"))
