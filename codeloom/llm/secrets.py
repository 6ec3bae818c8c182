"""Secret scan by a randomness test battery, with DataFrame functions only.

Base patterns find assignments, access keys and long hexadecimal strings. The method looks at
other long unbroken strings: it infers the encoding (hex, base32, base36, base64), tests the
symbols for uniformity (chi-squared), for runs above and below the middle of the alphabet, and
for serial correlation, and keeps strings that a uniform source could well have made. Whether
ordinary text of that length could have looked so too is a second p-value, from the index of
coincidence; over all candidates of all documents, the false-discovery rate is controlled within
each class of lengths (Benjamini-Hochberg on p-values rounded up to a grid, so that counts of a
fixed number of grid cells are all that is gathered).

Edge cases: null text is empty; documents without spans have counts 0, the hash of the empty
string and an empty span list; repeated rows give a row each; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

#: Base patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32
KINDS = ("assign", "access", "hex", "random")
#: Candidates of the method: unbroken strings of so many characters.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
#: Encodings as name, pattern, alphabet (folded to it by lower or upper case where
#: the encoding has one case), and the index of coincidence of ordinary text written in it.
ENCODINGS = (
    ("hex", r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", "0123456789abcdef", 0.115),
    ("HEX", r"^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", "0123456789ABCDEF", 0.115),
    ("base32", r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.067),
    ("base36", r"^(?=(?:.*[0-9]){3})(?=.*[a-z])[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz", 0.067),
    ("base64", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 0.055),
    ("base64url", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", 0.055),
)
#: Smallest combined p-value of the battery for a string to count as random; false-discovery rate.
LEAST_P, RATE = 0.01, 0.01
#: Grid of p-values: cells of a tenth of a power of ten.
CELLS = 300


def _normal_tail(z: Column) -> Column:
    """P(Z > z) for z >= 0 (Abramowitz and Stegun 26.2.17)."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly


def _upper(z: Column) -> Column:
    return F.when(z >= 0, _normal_tail(F.abs(z))).otherwise(1 - _normal_tail(F.abs(z)))


def spans_of(text: Column, pattern: str, least: int, group: int = 0) -> Column:
    """Leftmost matches that do not overlap, as (start, end, m) in code points; matches whose
    ``group`` is shorter than ``least`` are dropped after the search."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    kept = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length)
    rows = F.arrays_zip(gaps.alias("g"), matches.alias("m"), kept.alias("k"))
    empty = F.array().cast("array<struct<start:int,end:int,m:string,k:int>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["g"]
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.array_append(acc["found"], F.struct(start.alias("start"), end.alias("end"), x["m"].alias("m"), x["k"].alias("k"))).alias("found"))

    found = F.aggregate(F.filter(rows, lambda x: x["m"].isNotNull()), F.struct(F.lit(0).alias("at"), empty.alias("found")), step)["found"]
    return F.when(text.rlike(pattern), F.filter(found, lambda x: x["k"] >= least)).otherwise(empty)


def _indices(m: Column, alphabet: str) -> Column:
    return F.transform(F.split(m, ""), lambda c: F.instr(F.lit(alphabet), c) - 1)


def battery(m: Column) -> Column:
    """The tests on one string: encoding, n, p_random (combined) and p_text; null if no encoding fits."""
    out = F.lit(None).cast("struct<encoding:string,n:int,p_random:double,p_text:double>")
    for name, pattern, alphabet, text_ic in reversed(ENCODINGS):
        k = len(alphabet)
        values = _indices(m, alphabet)
        out = F.when(m.rlike(pattern), _tests(values, k, name, text_ic)).otherwise(out)
    return out


def _let(value: Column, f) -> Column:
    """``f`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _tests(values: Column, k: int, name: str, text_ic: float) -> Column:
    def moments(v: Column) -> Column:
        n = F.size(v).cast("double")
        counts = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.size(F.filter(v, lambda x: x == j)).cast("double"))
        total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
        mean = (k - 1) / 2.0
        pairs = F.slice(F.arrays_zip(v.alias("a"), F.slice(v, F.lit(2), F.size(v)).alias("b")), F.lit(1), F.size(v) - 1)
        return F.struct(
            n.alias("n"),
            total(F.transform(counts, lambda c: c * c)).alias("squares"),
            F.size(F.filter(v, lambda x: x >= k // 2)).cast("double").alias("high"),
            F.size(F.filter(pairs, lambda p: (p["a"] >= k // 2) != (p["b"] >= k // 2))).cast("double").alias("turns"),
            total(F.transform(pairs, lambda p: (p["a"] - mean) * (p["b"] - mean))).alias("lag"),
            total(F.transform(v, lambda x: (x - mean) * (x - mean))).alias("var"),
        )

    def result(s: Column) -> Column:
        n = s["n"]
        chi = F.greatest(s["squares"] * k / n - n, F.lit(1e-9))
        df = float(k - 1)
        p_chi = _upper((F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))
        mu = 1 + 2 * s["high"] * (n - s["high"]) / n
        spread = F.sqrt(F.greatest((mu - 1) * (mu - 2) / (n - 1), F.lit(1e-9)))
        p_runs = F.least(F.lit(1.0), 2 * _upper(F.abs(s["turns"] + 1 - mu) / spread))
        p_lag = F.least(F.lit(1.0), 2 * _upper(F.abs(s["lag"] / F.greatest(s["var"], F.lit(1e-9))) * F.sqrt(n)))
        ic = (s["squares"] - n) / (n * (n - 1))
        sd = F.sqrt((1.2 * text_ic * text_ic * n + 2 * text_ic) / (n * n))
        return F.struct(F.lit(name).alias("encoding"), n.cast("int").alias("n"), F.least(F.lit(1.0), 3 * F.least(p_chi, p_runs, p_lag)).alias("p_random"), _upper((text_ic - ic) / sd).alias("p_text"))

    return _let(_let(values, moments), result)


def _cell(p: Column) -> Column:
    """Cell of the p-value's grid; the grid value 10 ** (-cell / 10) is not below p."""
    return F.least(F.floor(-10 * F.log10(F.greatest(p, F.lit(1e-30)))), F.lit(CELLS)).cast("int")


def _length_class(n: Column) -> Column:
    return F.floor(F.log2(n.cast("double")) * 2).cast("int")


def thresholds(candidates: DataFrame, rate: float = RATE) -> dict[int, int]:
    """For each length class the smallest grid cell that Benjamini-Hochberg keeps."""
    cells = candidates.groupBy("class", "cell").agg(F.count("*").alias("n"))
    by = W.partitionBy("class")
    t = cells.select("class", "cell", F.sum("n").over(by).alias("all"), F.sum("n").over(by.orderBy(F.desc("cell"))).alias("found"))
    kept = t.where(F.pow(F.lit(10.0), -F.col("cell") / 10) * F.col("all") <= rate * F.col("found"))
    return {r[0]: r[1] for r in kept.groupBy("class").agg(F.min("cell")).collect()}


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """One row a document: doc_id, all_spans (kind, start, end; kind as its place in KINDS)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    t = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).select("doc_id", text.alias("text"))
    t = t.select(
        "doc_id",
        spans_of(F.col("text"), ASSIGN, ASSIGN_LEAST, 2).alias("s0"),
        spans_of(F.col("text"), ACCESS, ACCESS_LEAST).alias("s1"),
        spans_of(F.col("text"), HEX.replace("+", "{%d,}" % HEX_LEAST), HEX_LEAST).alias("s2"),  # a run is either long enough or not
        spans_of(F.col("text"), CANDIDATE, 20).alias("s3"),
    )
    short = lambda c, k: F.transform(c, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end")))
    base = F.concat(short("s0", 0), short("s1", 1), short("s2", 2))
    tested = F.filter(F.transform("s3", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), battery(x["m"]).alias("b"))), lambda x: x["b"]["p_random"] >= LEAST_P)
    candidates = F.transform(tested, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), _length_class(x["b"]["n"]).alias("class"), _cell(x["b"]["p_text"]).alias("cell")))
    t = stored(t.select("doc_id", F.array_sort(base).alias("base"), candidates.alias("candidates")), "secrets")
    least = thresholds(t.select(F.explode("candidates").alias("c")).select("c.class", "c.cell"), rate)
    passes = lambda x: F.lit(False)
    if least:
        limits = F.create_map(*[F.lit(v) for kv in sorted(least.items()) for v in kv])
        passes = lambda x: F.coalesce(x["cell"] >= F.try_element_at(limits, x["class"]), F.lit(False))
    added = F.filter("candidates", lambda x: passes(x) & ~F.exists("base", lambda b: (b["start"] <= x["start"]) & (b["end"] >= x["end"])))
    return t.select("doc_id", "base", F.array_sort(F.concat("base", short(added, 3))).alias("all_spans"))


def described(spans: str) -> Column:
    """kind:start:end by start, then kind, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    t = scan(docs)
    n = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return t.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(described("base"), 256).alias("base_sha256"), described("all_spans").alias("spans"))
