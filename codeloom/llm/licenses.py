"""Licence scan by a positional rare-token index, with DataFrame functions only.

The words of the licence templates are ranked by the number of documents that have them, the
highest inverse document frequency first; no word is too frequent to be looked up. The rarest words
of each template are its postings. A document looks up those of every template whose key phrases
it has all words of (the others cannot be verified), and every place votes for (template, place of
the template's first word). Votes for places up to SLACK words apart count together, so that words
put into a notice or left out of it do not lose it. Places with enough distinct words are verified:
each mandatory key phrase of the template must stand there, whole. The base phrases are found apart
from that, wherever they stand.

What is collected is one count for each word of the templates, a fixed number. Texts are never
exchanged between executors.

Edge cases: null text is empty; an empty document has n_base 0, null places, empty labels and
score 0; repeated rows give a row each; other columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base phrases with their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Licence notices: label, opening words, key phrases that must be there.
TEMPLATES = (
    ("mit", "released under the MIT license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted", "free of charge")),
    ("apache", "licensed under the Apache license version 2 0", ("apache license",)),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ("except in compliance with the license",)),
    ("gpl", "this work is licensed under the GNU general public license version 3", ("general public license",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the GNU general public license", ("redistribute it", "general public license")),
    ("lgpl", "under the terms of the GNU lesser general public license", ("lesser general public license",)),
    ("agpl", "under the terms of the GNU affero general public license", ("affero general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("source and binary forms",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    ("mpl", "this source code form is subject to the terms of the Mozilla public license v 2 0", ("mozilla public license",)),
    ("cc-by-nc", "licensed under CC BY NC 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under CC BY SA 4 0", ("cc by sa",)),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software",)),
    ("reserved", "all rights reserved no part of this work may be reproduced", ("all rights reserved",)),
)
#: So many of a template's rarest words are looked up; a place needs so many distinct words, and
#: this share of those looked up.
LOOK_UP, VOTES, LEAST_SCORE = 16, 2, 0.5
#: Places that votes for one notice may lie apart; twice so many words before and after a template's
#: place its key phrases may stand.
SLACK = 4
#: Added to places so that none is below zero; longer than any template.
FIRST = 256

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LICENCE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str) -> list[str]:
    return re.findall(LICENCE_WORD, text.translate(str.maketrans(UPPER, LOWER)))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(LICENCE_WORD), F.lit(0))


def _places(words: Column, n: Column, test) -> Column:
    """Indices from 0 whose word passes ``test``."""
    return F.filter(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: test(F.get(words, i)))


def document_frequency(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many documents each word of the vocabulary stands."""
    have = F.filter(F.array_distinct(_words(F.col("text"))), lambda w: w.isin(vocabulary))
    return {r.w: r.n for r in docs.select(F.explode(have).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score, and the verified places as (label, first word, score)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    templates = [(label, words_of(t), [words_of(p) for p in keys]) for label, t, keys in TEMPLATES]
    vocabulary = sorted({w for _, ws, _ in templates for w in ws})
    frequency = document_frequency(docs, vocabulary)
    rare = sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w))
    rank = {w: i for i, w in enumerate(rare)}  # the highest inverse frequency first

    t = docs.select("doc_id", _words(F.col("text")).alias("words"))
    t = t.select("doc_id", "words", F.size("words").alias("n"))
    at = lambda i: F.get("words", i)

    # base phrases: from each place of their last word backwards
    last = _places(F.col("words"), F.col("n"), lambda w: w == "license")

    def starts(phrase: str) -> Column:
        ws = words_of(phrase)
        fits = lambda i: F.expr("true") if len(ws) == 1 else _all(F.when(i >= len(ws) - 1 - k, at(i - (len(ws) - 1 - k)) == w).otherwise(False) for k, w in enumerate(ws[:-1]))
        return F.transform(F.filter("last", fits), lambda i: i - (len(ws) - 1))

    t = t.withColumn("last", F.when(F.array_contains("words", "license"), last).otherwise(F.array().cast("array<int>")))
    t = t.select("*", *[starts(p).alias(f"base{k}") for k, (p, _) in enumerate(PHRASES)])
    every = F.concat(*[F.col(f"base{k}") for k in range(len(PHRASES))])
    base_labels = F.array_sort(F.filter(F.array(*[F.when(F.size(f"base{k}") > 0, F.lit(x)) for k, (_, x) in enumerate(PHRASES)]), lambda x: x.isNotNull()))

    # the places of the rarest words of each template that the document can hold
    looked = [sorted(set(ws), key=rank.__getitem__)[:LOOK_UP] for _, ws, _ in templates]
    size = [len(x) for x in looked]
    postings = {w: [(k, p, looked[k].index(w)) for k, (_, ws, _) in enumerate(templates) if w in looked[k] for p, x in enumerate(ws) if x == w] for w in rare}
    need = [sorted({w for p in keys for w in p}) for _, _, keys in templates]
    t = t.withColumn("have", F.array_intersect("words", F.array(*map(F.lit, sorted({w for x in need for w in x})))))
    t = t.withColumn("can", F.filter(F.array(*[F.when(_all(F.array_contains("have", w) for w in x), F.lit(k)) for k, x in enumerate(need)]), lambda k: k.isNotNull()))
    ranks = F.create_map(*[x for w in rare for x in (F.lit(w), F.lit(rank[w]))])
    places = F.create_map(*[x for w in rare for x in (F.lit(rank[w]), F.array(*[F.struct(F.lit(k).alias("t"), F.lit(p).alias("p"), F.lit(j).alias("w")) for k, p, j in postings[w]]))])
    seek = F.array_distinct(F.flatten(F.transform("can", lambda k: F.get(F.array(*[F.array(*map(F.lit, x)) for x in looked]), k))))
    hits = F.when(F.size("can") > 0, F.transform(_places(F.col("words"), F.col("n"), lambda w: F.array_contains("seek", w)), lambda i: F.struct(ranks[at(i)].alias("r"), i.alias("i"))))
    t = t.withColumn("seek", seek).withColumn("hits", F.coalesce(hits, F.array().cast("array<struct<r:int,i:int>>")))
    # a vote as one number: template, bin of the place of the template's first word, place in the
    # bin, word of the template. Each counts in two bins that overlap by half, so that words up to
    # SLACK places apart, as inserted and missing words leave them, meet in one
    wide = 2 * SLACK

    def vote(q: Column, i: Column, k: int) -> Column:
        at = i - q["p"] + FIRST + k * SLACK
        return (((q["t"].cast("long") * (1 << 32) + (at / wide).cast("int") * 2 + k) * wide) + at % wide) * LOOK_UP + q["w"]

    votes = F.flatten(F.transform("hits", lambda x: F.flatten(F.transform(F.filter(places[x["r"]], lambda q: F.array_contains("can", q["t"])), lambda q: F.array(vote(q, x["i"], 0), vote(q, x["i"], 1))))))
    t = t.withColumn("votes", F.array_append(F.sort_array(F.array_distinct(votes)), F.lit(-1).cast("long")))
    zero = F.expr("named_struct('key', -1L, 'words', 0, 'at', 0, 'run', 0, 'best', 0, 'most', 0, 'found', CAST(array() AS ARRAY<STRUCT<key:BIGINT,n:INT,start:INT>>))")
    least = F.array(*[F.lit(max(VOTES, math.ceil(LEAST_SCORE * x))) for x in size])

    def count(acc: Column, x: Column) -> Column:
        """One vote more: the words seen as bits, and the place with the most votes of its bin."""
        key, at, word = F.floor(x / (wide * LOOK_UP)).cast("long"), F.pmod(F.floor(x / LOOK_UP), F.lit(wide)).cast("int"), F.call_function("shiftleft", F.lit(1), F.pmod(x, F.lit(LOOK_UP)).cast("int"))
        same = key == acc["key"]
        run = F.when(same & (at == acc["at"]), acc["run"] + 1).otherwise(F.lit(1))
        better = ~same | (run > acc["most"])
        code = F.pmod(acc["key"], F.lit(1 << 32))
        start = (F.floor(code / 2) * wide - F.pmod(code, F.lit(2)) * SLACK + acc["best"] - FIRST).cast("int")
        n = F.bit_count(acc["words"])
        done = F.when(n >= F.get(least, F.shiftright(acc["key"], 32).cast("int")), F.array_append(acc["found"], F.struct(acc["key"].alias("key"), n.alias("n"), F.greatest(start, F.lit(0)).alias("start")))).otherwise(acc["found"])
        return F.struct(
            key.alias("key"),
            F.when(same, acc["words"].bitwiseOR(word)).otherwise(word).alias("words"),
            at.alias("at"),
            run.alias("run"),
            F.when(better, at).otherwise(acc["best"]).alias("best"),
            F.when(better, run).otherwise(acc["most"]).alias("most"),
            F.when(same, acc["found"]).otherwise(done).alias("found"),
        )

    t = t.withColumn("found", F.aggregate("votes", zero, count)["found"])
    info = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(len(ws)).alias("len"), F.lit(size[k]).alias("size"), F.array(*[F.lit(f" {' '.join(p)} ") for p in keys]).alias("keys")) for k, (label, ws, keys) in enumerate(templates)])

    def verified(x: Column) -> Column:
        k, start = F.shiftright(x["key"], 32).cast("int"), x["start"]
        about = F.get(info, k)
        low = F.greatest(start - 2 * SLACK, F.lit(0))
        there = F.concat(F.lit(" "), F.array_join(F.slice("words", low + 1, about["len"] + 4 * SLACK), " "), F.lit(" "))
        return F.struct(about["label"].alias("label"), start.alias("start"), F.least(F.lit(1.0), x["n"] / about["size"]).alias("score"), F.forall(about["keys"], lambda p: F.contains(there, p)).alias("ok"))

    t = t.withColumn("checked", F.filter(F.transform("found", verified), lambda x: x["ok"] & (x["score"] >= LEAST_SCORE)))

    def beaten(x: Column, i: Column, step: int) -> Column:
        """Whether the place ``step`` further on is the same notice, and the better or earlier one."""
        y = F.get("checked", i + step)
        ahead = (y["score"] >= x["score"]) if step < 0 else (y["score"] > x["score"])
        return F.coalesce((y["label"] == x["label"]) & (F.abs(y["start"] - x["start"]) <= SLACK) & ahead, F.lit(False))

    # a notice found through both of its bins is one place; its bins stand side by side
    places = F.filter("checked", lambda x, i: ~(beaten(x, i, -2) | beaten(x, i, -1) | beaten(x, i, 1) | beaten(x, i, 2)))
    t = t.select("doc_id", F.col("n").cast("long").alias("n_words"), every.alias("every"), base_labels.alias("base"), places.alias("places"))
    return t.select(
        "doc_id",
        "n_words",
        F.size("every").cast("long").alias("n_base"),
        F.array_min("every").cast("long").alias("first_word"),
        F.array_max("every").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", F.transform("places", lambda x: x["label"])))), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda x: x["score"])), F.lit(0.0)).alias("score"),
        F.transform("places", lambda x: F.struct(x["label"].alias("label"), x["start"].alias("start"), x["score"].alias("score"))).alias("places"),
    )


def _all(tests) -> Column:
    out = None
    for x in tests:
        out = x if out is None else out & x
    return out
