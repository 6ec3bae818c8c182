"""The queries of these operators: each applies one to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, jaccard, licenses, merkle, minhash, mixing, periodic, pii, quality, quotes, secrets, substrings, token_files


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_digest(_table(spark, sf_dir, "documents"), tokenizer_path())


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_counts(_table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents")).drop("places")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(_table(spark, sf_dir, "documents"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_table(spark, sf_dir, "documents"))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_table(spark, sf_dir, "documents"), with_bytes=False).drop("kept")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.linked(_table(spark, sf_dir, "conversations"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.periodic_runs(_table(spark, sf_dir, "documents"), repeat_tails=True, with_text=False)


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(_table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified_manifest(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_token_files, op2_mixing, op3_quality, op4_licenses, op5_decontamination, op6_secrets, op7_personal_data, op8_substrings, op9_near_duplicates, op10_conversations, op11_periodic_runs, op12_jaccard_join, op13_merkle_manifest)}

#: Unsigned crc32 of the decimal doc_id: a step for each byte, eight for its bits.
_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda d: [ascii(d)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295)"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


#: SQL of the queries whose whole result it can express. The others rest on a tokenizer, keyed permutations,
#: zstandard or trained models.
ORACLE_SQL: dict[str, str] = {
    "op8_substrings": r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
blocks AS (SELECT doc_id, n, unnest(range(0, n - 99, 256)) AS block, h FROM d),
pieces AS (SELECT doc_id, n, block, substr(h, 2 * block + 1, 710) AS piece FROM blocks),
places AS (SELECT doc_id, block, piece, unnest(range(block, least(block + 256, n - 99))) AS p FROM pieces),
strings AS (SELECT doc_id, p, substr(piece, 2 * (p - block) + 1, 200) AS s FROM places),
later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM strings) WHERE k > 1),
steps AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM later),
runs AS (SELECT doc_id, p, sum(CASE WHEN before IS NULL OR p > before + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM steps),
spans AS (SELECT doc_id, run, min(p) AS a, max(p) + 100 AS b FROM runs GROUP BY doc_id, run),
ends AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS free FROM spans),
cut AS (SELECT e.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last,
          string_agg(substr(h, 2 * free + 1, 2 * (a - free)), '' ORDER BY a) AS kept FROM ends e JOIN d USING (doc_id) GROUP BY e.doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN cut.doc_id IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
""",
    "op9_near_duplicates": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, md5(array_to_string(list_slice(w, i, i + 4), ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS MATERIALIZED (
  SELECT x, y FROM shared s JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * s.n >= 75 * (a.n + b.n - s.n)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, ways.y FROM reach r JOIN ways ON ways.x = r.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(sizes.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM least LEFT JOIN sizes USING (doc_id)
""",
    "op11_periodic_runs": f"""
WITH texts AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, {_CRC} AS h FROM documents),
places AS (SELECT *, h // 10 AS g, len(w) AS n FROM texts),
tails AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM places),
docs AS MATERIALIZED (SELECT doc_id, r, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(0, n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END + 1]) END AS w FROM tails),
grams AS MATERIALIZED (SELECT r, n, i, md5(array_to_string(list_slice(w, i + 1, i + 5), ' ')) AS s FROM (SELECT r, n, w, unnest(range(0, n - 4)) AS i FROM docs)),
pairs AS (SELECT x.r, x.i, y.i - x.i AS q FROM grams x JOIN grams y ON x.r = y.r AND x.s = y.s AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
steps AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pairs),
found AS (SELECT r, q, min(i) AS start, count(*) + 4 + q AS length FROM steps GROUP BY r, q, island),
runs AS MATERIALIZED (SELECT r, start, length, min(q) AS q FROM found WHERE length >= greatest(6, 4 * q) GROUP BY r, start, length),
best AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY length DESC, start, q) AS k FROM runs),
told AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS t FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, i FROM (SELECT r, unnest(range(start + q, start + length)) AS i FROM runs)),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS t FROM (SELECT r, unnest(w) AS word, unnest(range(0, n)) AS i FROM docs WHERE r IN (SELECT r FROM runs)) ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b.start::BIGINT AS start, b.length::BIGINT AS length, b.q::BIGINT AS period, (1000 * b.length // b.q)::BIGINT AS exponent_milli,
  sha256(coalesce(told.t, '')) AS runs_sha256, sha256(coalesce(kept.t, array_to_string(w, ' '), '')) AS collapsed_sha256
FROM docs LEFT JOIN told USING (r) LEFT JOIN (SELECT * FROM best WHERE k = 1) b USING (r) LEFT JOIN kept USING (r)
""",
    "op12_jaccard_join": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, md5(array_to_string(list_slice(w, i, i + 2), ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS MATERIALIZED (
  SELECT x, y FROM shared s JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * s.n >= 90 * (a.n + b.n - s.n)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, ways.y FROM reach r JOIN ways ON ways.x = r.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(sizes.n, 0) AS n_shingles, component_id
FROM least LEFT JOIN sizes USING (doc_id)
""",
    "op13_merkle_manifest": f"""
WITH RECURSIVE leaves AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER () AS r
  FROM (SELECT doc_id, lang, {_leaf_sql('n_chars')} AS leaf, CASE WHEN {_CRC} % 7 = 0 THEN {_leaf_sql('(n_chars + 1)')} END AS claim FROM documents)),
nodes AS MATERIALIZED (
  SELECT lang, 0 AS level, i, n, leaf AS digest FROM leaves
  UNION ALL SELECT lang, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY lang, level, i // 2, n),
langs AS (SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS MATERIALIZED (
  SELECT 0 AS level, i, n, subroot AS digest FROM langs
  UNION ALL SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY level, i // 2, n),
up AS (
  SELECT r, lang, 0 AS level, i, n, coalesce(claim, leaf) AS digest, '' AS path FROM leaves
  UNION ALL SELECT r, u.lang, u.level + 1, u.i // 2, (u.n + 1) // 2,
    sha256(CASE WHEN s.digest IS NULL THEN u.digest WHEN u.i % 2 = 0 THEN u.digest || s.digest ELSE s.digest || u.digest END), path || coalesce(s.digest, '')
  FROM up u LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM u.lang AND s.level = u.level AND s.i = xor(u.i, 1) WHERE u.n > 1),
over AS (
  SELECT r, 0 AS level, l.i, l.n, digest, path, subroot FROM up JOIN langs l ON l.lang IS NOT DISTINCT FROM up.lang WHERE up.n = 1
  UNION ALL SELECT r, o.level + 1, o.i // 2, (o.n + 1) // 2,
    sha256(CASE WHEN s.digest IS NULL THEN o.digest WHEN o.i % 2 = 0 THEN o.digest || s.digest ELSE s.digest || o.digest END), path || coalesce(s.digest, ''), subroot
  FROM over o LEFT JOIN tops s ON s.level = o.level AND s.i = xor(o.i, 1) WHERE o.n > 1)
SELECT doc_id, leaf, subroot, t.digest AS root, sha256(path) AS proof_sha256, o.digest AS folded_root, o.digest = t.digest AS verified
FROM leaves JOIN over o USING (r) JOIN tops t ON t.n = 1 WHERE o.n = 1
""",
}
