"""What queries print: symbol rows, file lists, duplicate groups, symbol details, recommendations.

Each operator gives rows; ``lines`` turns rows into one of the output formats. Nothing is gathered
on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_test_file, kind_short

#: Kinds of opportunity in order of priority, with the impact limits of savings.
PRIORITIES = ("read_to_structure", "grep_to_usages", "grep_to_symbol", "multi_hop_to_definition", "find_grep_to_symbols", "grep_to_symbols")
HIGH, MEDIUM = 1000, 500
#: Changes in percent and calls beyond which a comparison is worth a sentence.
TIME_PCT, TOKEN_PCT, FEWER_CALLS = 20, 10, 1


def symbol_rows(symbols: DataFrame, location: Column) -> DataFrame:
    """id and the six printed columns; null visibility and container are empty."""
    context = F.when(F.col("is_test") | is_test_file(F.col("file")), "test").otherwise("prod")
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return symbols.select("id", "name", "kind", context.alias("context"), location.alias("location"), empty("visibility"), empty("container"))


def _quoted(c: Column) -> Column:
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(text.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def line(columns: list[str], form: str) -> Column:
    """One row as a line of ``csv``, ``tsv``, ``jsonl`` or ``text`` (that of symbol rows)."""
    if form == "csv":
        return F.concat_ws(",", *[_quoted(F.col(c)) for c in columns])
    if form == "tsv":
        return F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    if form == "jsonl":
        return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    if form == "text":
        wide = lambda c, n: F.when(F.length(c) < n, F.rpad(c, n, " ")).otherwise(F.col(c))
        where = F.when(F.col("container") != "", F.concat(F.lit(" in "), "container")).otherwise("")
        return F.concat(wide("kind", 10), F.lit(" "), wide("name", 30), F.lit(" ["), "context", F.lit("] "), "location", where)
    raise ValueError(f"no format {form}")


def targeted(found: DataFrame, rows: DataFrame, target: str = "target_id") -> DataFrame:
    """(target, count, results): the rows found for each target, by id."""
    of = found.select(target, "id").join(rows, "id")
    return of.groupBy(target).agg(F.count("*").alias("count"), F.array_sort(F.collect_list(F.struct(*rows.columns))).alias("results"))


def usage_files(refs: DataFrame, bindings: DataFrame) -> DataFrame:
    """(file, context, count, usages, import_via) of references with their definition's file and
    name: usages by place, and the imports by which the file has the names."""
    by = ["file", "def_file", "def_name"]
    via = refs.select(by).distinct().join(bindings.select("file", F.col("source_file").alias("def_file"), F.col("original_name").alias("def_name"), "import_text"), by).groupBy("file").agg(F.array_sort(F.collect_set("import_text")).alias("import_via"))
    used = refs.groupBy("file").agg(F.count("*").alias("count"), F.array_sort(F.collect_list(F.struct("start_pos", "end_pos", "def_name"))).alias("usages"))
    context = F.when(is_test_file(F.col("file")), "test").otherwise("prod")
    return used.join(via, "file", "left").select("file", context.alias("context"), "count", "usages", F.coalesce("import_via", F.array().cast("array<string>")).alias("import_via"))


def file_list(links: DataFrame, source: str, file: str, relation: str, transitive: bool = False) -> DataFrame:
    """(source_file, relation, transitive, count, files) of links from ``source`` to ``file``."""
    of = links.select(F.col(source).alias("source_file"), F.col(file).alias("f")).distinct()
    return of.groupBy("source_file").agg(F.count("*").alias("count"), F.array_sort(F.collect_list("f")).alias("files")).select("source_file", F.lit(relation).alias("relation"), F.lit(transitive).alias("transitive"), "count", "files")


def duplicate_report(groups: DataFrame) -> DataFrame:
    """(hash, count, ids, order) of duplicate groups (content_hash, n, id): the largest first; the
    hash's first 8 characters."""
    g = groups.groupBy("content_hash").agg(F.count("*").alias("count"), F.array_sort(F.collect_list("id")).alias("ids"))
    return g.select(F.left("content_hash", F.lit(8)).alias("hash"), "content_hash", "count", "ids").orderBy(F.desc("count"), "content_hash")


def by_count(rows: DataFrame, key: str) -> DataFrame:
    """Counts as one array of (key, n), the largest first, then by key."""
    n = rows.groupBy(key).agg(F.count("*").alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(key).alias("key"))))
    return n.agg(F.transform(pairs, lambda x: F.struct(x["key"].alias("key"), (-x["m"]).alias("n"))).alias("counts"))


def compact_outline(symbols: DataFrame) -> DataFrame:
    """(file, n, outline): name, short kind and place of each symbol, in the order of places."""
    one = F.struct("start_pos", "id", F.concat_ws(" ", "name", kind_short(F.col("kind")), F.col("start_pos").cast("string")).alias("text"))
    return symbols.groupBy("file").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(one)).alias("o")).select("file", "n", F.array_join("o.text", ",").alias("outline"))


def symbol_details(symbols: DataFrame, edges: DataFrame, refs: DataFrame) -> DataFrame:
    """(id, name, kind, outgoing, incoming, n_refs, ref_files): edges with their multiplicity, and
    references. Each side is reduced before it is joined."""

    def side(own: str, other: str, name: str) -> DataFrame:
        n = edges.groupBy(F.col(own).alias("id"), F.col(other).alias("other"), F.col("kind").alias("k")).agg(F.count("*").alias("n"))
        return n.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "other", "n"))).alias(name))

    used = refs.groupBy(F.col("symbol_id").alias("id")).agg(F.count("*").alias("n_refs"), F.count_distinct("file").alias("ref_files"))
    t = symbols.select("id", "name", "kind").join(side("src", "dst", "outgoing"), "id", "left").join(side("dst", "src", "incoming"), "id", "left").join(used, "id", "left")
    none = F.array().cast("array<struct<k:string,other:string,n:bigint>>")
    return t.select("id", "name", "kind", F.coalesce("outgoing", none).alias("outgoing"), F.coalesce("incoming", none).alias("incoming"), F.coalesce("n_refs", F.lit(0)).cast("long").alias("n_refs"), F.coalesce("ref_files", F.lit(0)).cast("long").alias("ref_files"))


def impact(saved: Column) -> Column:
    return F.when(saved >= HIGH, "high").when(saved >= MEDIUM, "medium").otherwise("low")


def recommendations(opportunities: DataFrame) -> DataFrame:
    """(priority, type, n, saved) of opportunities (type, saved), for the kinds that occur."""
    priority = F.array_position(F.array(*map(F.lit, PRIORITIES)), F.col("type"))
    found = opportunities.groupBy("type").agg(F.count("*").alias("n"), F.sum("saved").cast("long").alias("saved"))
    return found.select(priority.cast("int").alias("priority"), "type", "n", "saved").where("priority > 0")


def ranked_opportunities(opportunities: DataFrame, order: list[str]) -> DataFrame:
    """The largest savings first; equal ones in the order they came."""
    return opportunities.orderBy(F.desc("saved"), *order)


def insights(time_pct: Column, token_pct: Column, fewer_greps: Column, fewer_reads: Column, name: str = "Treatment") -> Column:
    """Sentences on a comparison, in fixed order; an array."""
    pct = lambda c: F.format_string("%.0f%%", F.abs(c))
    calls = lambda c, tool: F.when(c > FEWER_CALLS, F.concat(F.lit(f"{tool} calls reduced by "), F.format_string("%.1f", c), F.lit(" on average")))
    speed = F.when(time_pct < -TIME_PCT, F.concat(F.lit(f"{name} is "), pct(time_pct), F.lit(" faster"))).when(time_pct > TIME_PCT, F.concat(F.lit(f"{name} is "), pct(time_pct), F.lit(" slower")))
    tokens = F.when(token_pct < -TOKEN_PCT, F.concat(F.lit("Token usage reduced by "), pct(token_pct))).when(token_pct > TOKEN_PCT, F.concat(F.lit("Token usage increased by "), pct(token_pct)))
    return F.array_compact(F.array(speed, tokens, calls(fewer_greps, "Grep"), calls(fewer_reads, "Read")))


def compared_conditions(names: list[str], preferred: tuple[str, str] = ("control", "treatment")) -> tuple[str, str]:
    """The two conditions to compare: the preferred ones if both are there, else the first two."""
    if set(preferred) <= set(names):
        return preferred
    if len(names) < 2:
        raise ValueError(f"two conditions are needed, found {names}")
    return names[0], names[1]
