"""Token-ID output: flat unsigned integer files, 64-bit document offsets, prefix-sum bases.

Format of a shard: ``NAME.bin`` holds the ids of its documents one after another (unsigned
16-bit little-endian where every id fits, else 32-bit), ``NAME.idx`` holds n + 1 signed 64-bit
offsets in ids from the shard's start, ``NAME.doc`` holds n signed 64-bit document ids (the
smallest 64-bit number stands for null). ``manifest.json`` lists the shards in order with the
number of ids before each, so a global position is ``base + offset``. All files can be mapped.

Edge cases: null text is empty, and an empty document has only the end id; null ids come first;
repeated ids are ordered by a hash of the text, then the text, and each row is a document of its
own; an empty table gives a manifest without shards; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_sizes, filesystem, map_batches, partitions, pieces, read_bytes, rows_out, work_path, write_bytes

NO_ID = -(2**63)
SHARD = "name string, part int, first_id long, n_docs long, n_tokens long"
DIGEST = "doc_id long, start long, n_tokens long, ids_crc32 long"
_DIGEST = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
#: Pieces that one process remembers, and the longest of them in characters (about 120 MB); the
#: memory is emptied beyond that.
MEMORY, LONGEST = 600_000, 64
#: Bytes of text in a shard at most, on average; bytes of ids read at once.
SHARD_BYTES, READ_BYTES = 256 << 20, 8 << 20

#: Fixed value: how a byte-level vocabulary writes a space.
SPACE_BYTE = "\u0120"

_TWO_SPACES = re.compile(r"\s\s")
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")


class Encoder:
    """Whole-text encoding through the tokenizers library, remembering encoded pieces.

    A byte-level BPE with the library's own pre-token pattern and no normaliser always starts a
    pre-token at a single space between two non-space characters, so the pieces between such spaces
    are encoded independently and their ids joined: the same ids as for the whole text. Texts with
    the string of an added token, and all texts under a tokenizer of another kind, are encoded
    whole. With ``special_as_text`` strings of special tokens in a text are ordinary text.
    """

    def __init__(self, path: str, end_id: int, special_as_text: bool = False):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        told = json.loads(self.tokenizer.to_str())
        before = told["pre_tokenizer"] or {}
        self.cuts = told["model"]["type"] == "BPE" and not told["normalizer"] and not told["truncation"] and not told["padding"] and before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and not told["model"].get("dropout")
        self.added = [x["content"] for x in told["added_tokens"] if not (special_as_text and x["special"])]
        self.dtype = np.dtype("<u2" if max(self.tokenizer.get_vocab_size(), end_id + 1) <= 65536 else "<u4")
        self.end = np.array([end_id], self.dtype).tobytes()
        self.spaced = np.array([(self.tokenizer.id_to_token(i) or "").startswith(SPACE_BYTE) for i in range(self.tokenizer.get_vocab_size())])
        self.first: dict[str, bytes] = {}
        self.rest: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(got.ids, self.dtype) for got in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, known: dict[str, bytes], lead: str, pieces: set[str]) -> list[str]:
        """Add ``pieces`` to ``known``, each encoded with ``lead`` (nothing or a space) before it;
        returns the new ones that are too long to be remembered.

        Pieces led by a space are encoded many in a row: an id that begins with a space begins the
        next piece. Where the number of these is not that of the pieces (spaces inside a piece or
        merged with other white space), and without a lead, each is encoded by itself.
        """
        new = list(pieces.difference(known))
        for i in range(0, len(new), 2000):
            some = new[i : i + 2000]
            if lead:
                ids = self._ids([lead + lead.join(some)])[0]
                at = np.flatnonzero(self.spaced[ids])
                if len(at) == len(some) and not any(" " in x for x in some):
                    data, at = ids.tobytes(), (np.append(at, len(ids)) * self.dtype.itemsize).tolist()
                    known.update(zip(some, [data[j:k] for j, k in zip(at, at[1:])]))
                    continue
            known.update(zip(some, [x.tobytes() for x in self._ids([lead + x for x in some])]))
        return [x for x in new if len(x) > LONGEST]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text and the end id, as bytes of the files' type."""
        if len(self.first) + len(self.rest) > MEMORY:
            self.first.clear()
            self.rest.clear()
        cut, whole, heads, tails = [], {}, set(), set()
        for k, text in enumerate(texts):
            text = text or ""
            if not self.cuts or any(x in text for x in self.added):
                whole[k] = self._ids([text])[0].tobytes() + self.end
                cut.append(None)
                continue
            parts = _LONE_SPACE.split(text) if _TWO_SPACES.search(text) else text.split(" ")
            heads.add(parts[0])
            tails.update(parts[1:])
            cut.append(parts)
        long = self._learn(self.first, "", heads), self._learn(self.rest, " ", tails)
        get = self.rest.__getitem__
        out = [whole[k] if x is None else self.first[x[0]] + b"".join(map(get, x[1:])) + self.end for k, x in enumerate(cut)]
        for known, pieces in zip((self.first, self.rest), long, strict=True):
            for x in pieces:
                del known[x]
        return out


@lru_cache(maxsize=2)
def _encoder(path: str, end_id: int) -> Encoder:
    return Encoder(path, end_id)


def write_token_files(docs: DataFrame, out: str, tokenizer: str, end_id: int = 2, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Encode ``docs`` into token files under the URI ``out`` and return the manifest.

    One range exchange deals the texts into shards in id order; each task writes its own files
    under a name of its attempt, and only the names that finished tasks report are in the
    manifest, so repeated attempts leave nothing wrong behind. The driver sees one row a shard.
    """
    spark = docs.sparkSession
    dtype = _encoder(tokenizer, end_id).dtype

    def write(batches):
        task = TaskContext.get()
        name = f"shard-{task.partitionId():06d}-{task.taskAttemptId()}"
        files, sizes, ids = None, [np.zeros(1, np.int64)], []
        encoder = _encoder(tokenizer, end_id)
        for batch in batches:
            if not batch.num_rows:
                continue
            if files is None:
                files, path = filesystem(f"{out}/{name}")
                files.create_dir(path.rpartition("/")[0], recursive=True)
                data = files.open_output_stream(f"{path}.bin")
            texts = batch.column("text")
            for i, j in pieces(byte_sizes(texts), 1 << 18):
                encoded = encoder.encode(texts.slice(i, j - i).to_pylist())
                data.write(b"".join(encoded))
                sizes.append(np.array([len(x) for x in encoded], np.int64) // dtype.itemsize)
            ids.append(batch.column("id").fill_null(NO_ID).to_numpy())
        if files is None:
            return
        data.close()
        offsets = np.cumsum(np.concatenate(sizes), dtype="<i8")
        ids = np.concatenate(ids).astype("<i8")
        for kind, array in (("idx", offsets), ("doc", ids)):
            with files.open_output_stream(f"{path}.{kind}") as f:
                f.write(array.tobytes())
        yield pa.RecordBatch.from_pydict({"name": [name], "part": pa.array([task.partitionId()], pa.int32()), "first_id": [int(ids[0])], "n_docs": [len(ids)], "n_tokens": [int(offsets[-1])]})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    if not shards:
        size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        shards = max(partitions(spark), -(-size // SHARD_BYTES))
    key = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    dealt = rows.repartitionByRange(shards, *key).sortWithinPartitions(*key, "text")
    found, base = sorted(map_batches(dealt, write, SHARD).collect(), key=lambda r: (r.first_id, r.part)), 0
    manifest = []
    for r in found:
        manifest.append({"name": r.name, "n_docs": r.n_docs, "n_tokens": r.n_tokens, "base": base})
        base += r.n_tokens
    write_bytes(f"{out}/manifest.json", json.dumps({"dtype": dtype.str, "end_id": end_id, "shards": manifest}).encode())
    return manifest


def read_token_files(spark: SparkSession, out: str) -> DataFrame:
    """Per document of the files under ``out``: doc_id, start, n_tokens, ids_crc32.

    Files are read by ranges, of READ_BYTES or one document's ids.
    """
    told = json.loads(read_bytes(f"{out}/manifest.json"))
    dtype = np.dtype(told["dtype"])

    def read(batches):
        for batch in batches:
            for name, base in zip(batch.column("name").to_pylist(), batch.column("base").to_pylist(), strict=True):
                files, path = filesystem(f"{out}/{name}")
                with files.open_input_file(f"{path}.bin") as ids, files.open_input_file(f"{path}.idx") as idx, files.open_input_file(f"{path}.doc") as doc:
                    n = doc.size() // 8
                    for first in range(0, n, 1 << 16):
                        some = min(1 << 16, n - first)
                        at = np.frombuffer(idx.read_at(8 * (some + 1), 8 * first), "<i8")
                        docs = np.frombuffer(doc.read_at(8 * some, 8 * first), "<i8")
                        for i, j in pieces((np.diff(at) * dtype.itemsize).tolist(), READ_BYTES):
                            data = np.frombuffer(ids.read_at(int(at[j] - at[i]) * dtype.itemsize, int(at[i]) * dtype.itemsize), dtype).astype("<u4")
                            crc = [zlib.crc32(data[a - at[i] : b - at[i]]) for a, b in zip(at[i:j], at[i + 1 : j + 1], strict=True)]
                            yield rows_out({"doc_id": pa.array(docs[i:j], mask=docs[i:j] == NO_ID), "start": base + at[i:j], "n_tokens": np.diff(at[i : j + 1]), "ids_crc32": crc}, _DIGEST)

    shards = [(x["name"], x["base"]) for x in told["shards"]]
    table = spark.createDataFrame(shards, "name string, base long")
    return map_batches(table.repartition(max(1, min(len(shards), partitions(spark)))), read, DIGEST)


def token_digest(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write ``docs`` as token files in the shared folder and describe them from the files."""
    out = work_path(docs.sparkSession, "tokens")
    write_token_files(docs, out, tokenizer, end_id)
    return read_token_files(docs.sparkSession, out)
