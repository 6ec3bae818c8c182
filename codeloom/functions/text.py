"""Scalar functions as column expressions: paths, text, positions, tokens."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import INDEXED, KIND_SHORT, LANGUAGES


def normalize_path(p: Column) -> Column:
    return F.translate(p, "\\", "/")


def strip_extension(p: Column) -> Column:
    return F.regexp_replace(p, r"^(.+)\.[^./]*$", "$1")


def extension(p: Column) -> Column:
    return F.lower(F.regexp_extract(p, r"\.([^./]*)$", 1))


def resolve_dots(p: Column) -> Column:
    """Resolve ``.`` and ``..`` and collapse slashes; ``..`` at the top is dropped."""
    parts = F.aggregate(F.split(p, "/"), F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(x.isin("", "."), acc).otherwise(F.array_append(acc, x)))
    return F.concat(F.when(p.startswith("/"), "/").otherwise(""), F.array_join(parts, "/"))


def last_segment(s: Column, sep: str) -> Column:
    return F.substring_index(s, sep, -1)


def squeeze(s: Column) -> Column:
    """Runs of ASCII white space (not VT) become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(s, r"[ \t\n\f\r]+", " "))


def content_hash(s: Column) -> Column:
    """Null below 50 bytes, raw or squeezed; else 16 hex digits of a hash of the squeezed text."""
    plain = squeeze(s)
    return F.when((F.octet_length(s) >= 50) & (F.octet_length(plain) >= 50), F.left(F.sha2(plain, 256), F.lit(16)))


def line_starts(content: Column) -> Column:
    """Byte offsets of the line starts."""
    lines = F.split(content, "\n")
    sizes = F.transform(F.slice(lines, F.lit(1), F.size(lines) - 1), lambda x: (F.octet_length(x) + 1).cast("long"))
    return F.aggregate(sizes, F.array(F.lit(0).cast("long")), lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n))


def line_and_column(starts: Column, offset: Column, size: Column) -> Column:
    """1-based line and byte column of an offset; null beyond the end."""
    line = F.size(F.filter(starts, lambda v: v <= offset))
    return F.when((offset >= 0) & (offset <= size), F.struct(line.cast("long").alias("line"), (offset - F.get(starts, line - 1) + 1).cast("long").alias("col")))


def offset_of(content: Column, line: Column, col: Column) -> Column:
    """Byte offset of a 1-based position; the column stops at the line's end; null for 0 or beyond."""
    lines, starts = F.split(content, "\n"), line_starts(content)
    return F.when((line >= 1) & (col >= 1) & (line <= F.size(lines)), F.get(starts, line.cast("int") - 1) + F.least(col - 1, F.octet_length(F.get(lines, line.cast("int") - 1)).cast("long")))


def identifier_at(content: Column, offset: Column) -> Column:
    """The ASCII identifier that touches a character offset."""
    left = F.regexp_extract(F.substring(content, F.lit(1), offset.cast("int")), r"([A-Za-z0-9_]*)$", 1)
    right = F.regexp_extract(F.substring(content, offset.cast("int") + 1, F.length(content)), r"^([A-Za-z0-9_]*)", 1)
    return F.nullif(F.concat(left, right), F.lit(""))


def snippet(content: Column, start: Column, end: Column) -> Column:
    """Text of a byte range; null out of range."""
    data = F.encode(content, "UTF-8")
    return F.when((start >= 0) & (end <= F.octet_length(data)) & (start <= end), F.decode(F.substring(data, start.cast("int") + 1, (end - start).cast("int")), "UTF-8"))


def is_test_file(p: Column) -> Column:
    """Test folders and test name endings, whatever the case."""
    low = F.lower(normalize_path(p))
    return low.rlike(r"/(tests|__tests__|test|spec)/") | low.rlike(r"(\.test\.(ts|tsx|js|jsx)|\.spec\.(ts|tsx|js|jsx)|_test\.rs|_test\.go|_spec\.rb)$")


def language(p: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, extension(p)), F.lit("other"))


def is_supported(p: Column) -> Column:
    return extension(p).isin(*INDEXED)


def position_argument(s: Column) -> Column:
    """``path:line:col`` cut into its parts; null if the last two are not numbers."""
    pattern = r"^(.+):(\d+):(\d+)$"
    return F.when(s.rlike(pattern), F.struct(F.regexp_extract(s, pattern, 1).alias("path"), F.regexp_extract(s, pattern, 2).cast("long").alias("line"), F.regexp_extract(s, pattern, 3).cast("long").alias("col")))


def kind_short(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in KIND_SHORT.items() for x in kv])
    return F.coalesce(F.try_element_at(table, kind), F.lit("??"))


def estimated_tokens(s: Column) -> Column:
    """0 for none, else a quarter of the characters, at least 1."""
    n = F.length(F.coalesce(s, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("long")


def identifier_like(pattern: Column) -> Column:
    """Whether a search pattern, without regex marks around it, looks like a name in code."""
    bare = F.regexp_replace(pattern, r"^[\\^$.*+?()\[\]{}|]+|[\\^$.*+?()\[\]{}|]+$", "")
    return bare.rlike(r"^[a-z]+[A-Z][A-Za-z0-9]*$|^[A-Z][A-Za-z0-9]+$|^[a-z0-9]+(_[a-z0-9]+)+$|^[A-Z0-9]+(_[A-Z0-9]+)+$|^[a-zA-Z_][a-zA-Z0-9_]{2,}$")


def definition_like(pattern: Column) -> Column:
    return pattern.rlike(r"(^|[^A-Za-z])(def|class|function|func|fn|struct|interface|enum|trait|impl|const|let|var)(\\s|\s)")


def final_answers(s: Column) -> Column:
    return F.array_join(F.transform(F.regexp_extract_all(s, F.lit(r"FINAL_ANSWER:[ \t]*([^\n]+)"), F.lit(1)), lambda x: F.trim(x)), "\n")


def gold_files(patch: Column) -> Column:
    """Sorted files that a unified diff touches."""
    one = F.regexp_extract_all(patch, F.lit(r"(?m)^diff --git a/([^ \n]+) b/([^ \n]+)"), F.lit(2))
    two = F.regexp_extract_all(patch, F.lit(r"(?m)^\+\+\+ b/([^\n]+)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.concat(one, two)))


def number_with_commas(n: Column) -> Column:
    return F.format_number(n, 0)


def safe_branch(name: Column) -> Column:
    return F.regexp_replace(name, r"[^A-Za-z0-9._-]", "-")


def like_escaped(text: str) -> str:
    return re.sub(r"([\\%_])", r"\\\1", text)


def glob_to_like(pattern: str, compat: bool = True) -> str:
    """``*`` is any text, ``?`` any character; in compat mode ``%`` and ``_`` stay wildcards."""
    return (pattern if compat else like_escaped(pattern)).replace("*", "%").replace("?", "_")


def glob_match(text: Column, pattern: str) -> Column:
    """``*`` only: prefix, suffix, and the parts between in order behind the prefix; the suffix may
    share characters with them, so that ``ab*b`` matches ``ab``."""
    first, *rest = pattern.split("*")
    if not rest:
        return text == pattern
    middle = [re.escape(x) for x in rest[:-1] if x]
    out = text.startswith(first) & text.endswith(rest[-1])
    return out & text.rlike("^(?s:" + ".*".join([re.escape(first), *middle]) + ")") if middle else out
