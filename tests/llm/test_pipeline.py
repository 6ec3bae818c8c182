"""The pipeline on the smallest tables: each stage against the plain version of its decision."""

import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
from test_llm_operators import brute_near, brute_overlaps, words
from tokenizers import Tokenizer

from codeloom.llm import decontamination, quality
from codeloom.llm.common import stored
from codeloom.llm.queries import tokenizer_path


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    rows = [tuple(r) for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf), "stage")
        now = [tuple(r) for r in docs.collect()]
        if name == "quality rules":
            assert Counter(now) == Counter(r for r in rows if quality.measures(r[1])[6])
        elif name == "near duplicates":
            keep = {r[0] for r in brute_near(rows) if r[3]}
            assert Counter(now) == Counter(r for r in rows if r[0] in keep)
        elif name == "decontamination":
            bench = spark.read.parquet(f"{sf}/benchmark.parquet")
            items = {r.item_id: r.text for r in bench.collect()}
            grams = {tuple(x[i : i + 13]) for t in items.values() for x in [[w.lower() for w in words(t)]] for i in range(len(x) - 12)}
            holds = lambda t: any(tuple(x[i : i + 13]) in grams for x in [[w.lower() for w in words(t)]] for i in range(len(x) - 12))
            told = {}
            for r in decontamination.contamination(spark.createDataFrame(rows, docs.schema), bench).collect():
                told.setdefault(r.doc_id, []).append(r)
            gone = Counter(rows) - Counter(now)
            assert not Counter(now) - Counter(rows) and gone
            assert {r for r in rows if holds(r[1])} <= set(gone)
            assert all(brute_overlaps(r[1], items[x.item_id]) == x.n_equal for r in gone for x in told[r[0]])
        elif name == "mixing":
            assert {r[0] for r in now} <= {r[0] for r in rows}
            assert sum(len(words(r[1])) for r in now) > 1.3 * sum(len(words(r[1])) for r in rows)
        else:
            t = Tokenizer.from_file(tokenizer_path())
            crc = Counter((r[0], zlib.crc32(np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for r in rows)
            assert crc == Counter((r[docs.columns.index("doc_id")], r[docs.columns.index("ids_crc32")]) for r in now)
            assert len(now) == len(rows) and sum(r[docs.columns.index("n_tokens")] for r in now) == max(r[docs.columns.index("start")] + r[docs.columns.index("n_tokens")] for r in now)
            break
        assert docs.columns == columns
        rows = now
