"""Where imports lead: candidate files as arrays, chosen by one join with the files that exist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import dealt
from .text import resolve_dots, strip_extension

#: Endings tried after a specifier, and words that stand for a symbol by its kind.
ENDINGS = ("", ".ts", ".tsx", "/index.ts", "/index.tsx")
KIND_WORDS = ("fn", "function", "class", "interface", "enum", "struct", "impl")


def folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def _bare(specifier: Column) -> Column:
    return F.regexp_replace(F.trim(specifier), "^[\"']+|[\"']+$", "")


def _joined(base: Column, path: Column) -> Column:
    return resolve_dots(F.when(path.startswith("/"), path).otherwise(F.concat(base, F.lit("/"), path)))


def import_qualifier(file: Column, specifier: Column) -> Column:
    """The path an import names, without its ending."""
    return strip_extension(_joined(folder(file), _bare(specifier)))


def import_candidates(file: Column, specifier: Column) -> Column:
    """Files that a relative or absolute specifier may name, in order; null for a package."""
    bare = _bare(specifier)
    base = _joined(folder(file), bare)
    return F.when(bare.startswith(".") | bare.startswith("/"), F.array(*[F.concat(base, F.lit(x)) for x in ENDINGS]))


def module_candidates(use_path: Column, file: Column, root: Column) -> Column:
    """Files that a ``::`` path may name, in order: below the crate's root, the folder above or the
    file's own; the crate's ``lib.rs`` by ``crate`` alone or the crate's name; null for ``self``."""
    parts, here = F.split(use_path, "::"), folder(file)
    first, second, above = F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), folder(here)
    module = lambda base, name: F.array(F.concat(base, F.lit("/"), name, F.lit(".rs")), F.concat(base, F.lit("/"), name, F.lit("/mod.rs")))
    lib = F.array(F.concat(root, F.lit("/lib.rs")))
    crate = F.replace(F.regexp_extract(folder(root), "([^/]*)$", 1), F.lit("-"), F.lit("_"))
    own = F.concat(module(here, first), F.when(root.isNotNull() & (first == crate), lib).otherwise(F.array().cast("array<string>")))
    of_crate = F.when(second.isNull(), lib).otherwise(module(root, second))
    of_above = F.when(second.isNull(), F.array(F.concat(above, F.lit("/mod.rs")))).otherwise(module(above, second))
    return F.when(first == "crate", F.when(root.isNotNull(), of_crate)).when(first == "super", of_above).when(first != "self", own)


def first_existing(rows: DataFrame, key: str, candidates: Column, files: DataFrame, best_effort: Column | None = None) -> DataFrame:
    """(key, resolved): the first candidate that is a file (column file), else ``best_effort``."""
    other = F.lit(None).cast("string") if best_effort is None else best_effort
    c = rows.select(key, other.alias("_other"), F.posexplode_outer(candidates).alias("_rank", "_path"))
    n = c.count() + files.count()
    known = dealt(files.select(F.col("file").alias("_path"), F.lit(True).alias("_there")), n, "_path").distinct()
    pick = F.min(F.when(F.col("_there"), F.struct("_rank", "_path")))["_path"]
    return dealt(dealt(c, n, "_path").join(known, "_path", "left"), n, key).groupBy(key).agg(F.coalesce(pick, F.min("_other")).alias("resolved"))


def identifier_matches(identifier: Column, name: Column) -> Column:
    return (identifier == name) | identifier.isin(*KIND_WORDS)


def duration(seconds: Column) -> Column:
    """Seconds with one place, minutes and seconds, or hours and minutes."""
    whole = lambda c: F.format_string("%.0f", c.cast("double"))
    minutes = F.concat(whole(F.floor(seconds / 60)), F.lit("m "), whole(F.bround(seconds % 60)), F.lit("s"))
    hours = F.concat(whole(F.floor(seconds / 3600)), F.lit("h "), whole(F.floor(seconds % 3600 / 60)), F.lit("m"))
    return F.when(seconds < 60, F.concat(F.format_string("%.1f", seconds), F.lit("s"))).when(seconds < 3600, minutes).otherwise(hours)
