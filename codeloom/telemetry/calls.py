"""Assistant transcripts: turns, tool calls, token accounting and patterns of calls."""

from __future__ import annotations

import shlex

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import definition_like, estimated_tokens, identifier_like

#: Savings thresholds, look-back in calls, and least savings of the sequence rules.
GREP_BACK, FIND_BACK, LEAST_SAVED = 5, 3, 100
#: Hypothetical tokens of the replacement tools.
GREP_TYPICAL, SEQUENCE_TYPICAL, STRUCTURE_BASE = 150, 300, 200
#: File endings that count as code.
CODE = r"\.(py|ts|tsx|js|jsx|rs|go|java|kt|kts|c|h|cc|cpp|cxx|hpp|cs|rb|php|swift|scala|m|mm)$"


def load_messages(spark, path: str) -> DataFrame:
    """Messages-API transcripts: (session_id, msg_idx, role, block_idx, block)."""
    block = "struct<type:string,text:string,id:string,name:string,input:map<string,string>,tool_use_id:string,content:string>"
    t = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.parse_json("value").alias("v"))
    sid = F.coalesce(F.try_variant_get("v", "$.session_id", "string"), F.try_variant_get("v", "$.id", "string"), F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1))
    m = t.select(sid.alias("session_id"), F.posexplode(F.try_variant_get("v", "$.messages", "array<variant>")).alias("msg_idx", "m"))
    return _blocks(m.select("session_id", "msg_idx", F.try_variant_get("m", "$.role", "string").alias("role"), F.try_variant_get("m", "$.content", "variant").alias("c")), block)


def _blocks(m: DataFrame, block: str) -> DataFrame:
    blocks = F.coalesce(F.try_variant_get("c", "$", f"array<{block}>"), F.array(F.struct(F.lit("text").alias("type"), F.try_variant_get("c", "$", "string").alias("text"), *[F.lit(None).cast("string").alias(x) for x in ("id", "name")], F.lit(None).cast("map<string,string>").alias("input"), F.lit(None).cast("string").alias("tool_use_id"), F.lit(None).cast("string").alias("content"))))
    return m.select("session_id", "msg_idx", "role", F.posexplode(blocks).alias("block_idx", "block"))


def native_records(spark, path: str, **options) -> DataFrame:
    """(path, msg_idx, v): the records of JSON-lines transcripts; msg_idx is the byte at which a record's
    line begins, so that records of a file keep their order however it is cut."""
    from ..sources.transcripts import register

    t = spark.read.format(register(spark)).options(path=path, **options).load()
    return t.select("path", F.col("offset").alias("msg_idx"), F.try_parse_json("value").alias("v")).where("v is not null")


def message_usage(records: DataFrame) -> DataFrame:
    """(session_id, msg_idx, model, input_tokens, output_tokens, cache_read, cache_written) of the
    assistant's messages; a field that a record lacks is null."""
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    of = {"input_tokens": "input_tokens", "output_tokens": "output_tokens", "cache_read": "cache_read_input_tokens", "cache_written": "cache_creation_input_tokens"}
    rows = records.where(get("$.type", "string") == "assistant")
    return rows.select(get("$.sessionId", "string").alias("session_id"), "msg_idx", get("$.message.model", "string").alias("model"), *[get(f"$.message.usage.{x}", "long").alias(name) for name, x in of.items()])


def load_native(spark, path: str, **options) -> DataFrame:
    """JSON-lines transcripts with one record a line; other records than messages are left out."""
    block = "struct<type:string,text:string,id:string,name:string,input:map<string,string>,tool_use_id:string,content:string>"
    t = native_records(spark, path, **options)
    t = t.where(F.try_variant_get("v", "$.type", "string").isin("user", "assistant"))
    return _blocks(t.select(F.try_variant_get("v", "$.sessionId", "string").alias("session_id"), "msg_idx", F.try_variant_get("v", "$.message.role", "string").alias("role"), F.try_variant_get("v", "$.message.content", "variant").alias("c")), block)


def is_native(spark, path: str) -> bool:
    """By the first record's type."""
    first = spark.read.text(path).limit(1).select(F.try_variant_get(F.try_parse_json("value"), "$.type", "string")).first()
    return bool(first) and first[0] in ("user", "assistant", "queue-operation")


def tool_calls(blocks: DataFrame) -> DataFrame:
    """Tool uses with the last result of their id."""
    uses = blocks.where("block.type = 'tool_use'").select("session_id", "msg_idx", "block_idx", F.col("block.id").alias("tool_use_id"), F.col("block.name").alias("tool_name"), F.col("block.input").alias("tool_input"))
    results = blocks.where("block.type = 'tool_result'").groupBy("session_id", F.col("block.tool_use_id").alias("tool_use_id")).agg(F.max_by("block.content", "msg_idx").alias("result"))
    out = uses.join(results, ["session_id", "tool_use_id"], "left")
    return out.withColumn("input_tokens", estimated_tokens(F.concat("tool_name", F.lit(": "), F.to_json("tool_input")))).withColumn("result_tokens", estimated_tokens(F.col("result")))


def turns(messages: DataFrame, session: str, order: list[str]) -> DataFrame:
    """Each assistant message starts a turn; messages before the first have turn 0."""
    w = W.partitionBy(session).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return messages.withColumn("turn_no", F.sum(F.when(F.col("role") == "assistant", 1).otherwise(0)).over(w).cast("long"))


def context_tokens(turns: DataFrame, session: str, order: str, task: str, out: str, results: str) -> DataFrame:
    """Tokens that each turn reads: the task, and all outputs and results before."""
    w = W.partitionBy(session).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return turns.withColumn("context_tokens", (F.col(task) + F.coalesce(F.sum(F.col(out) + F.col(results)).over(w), F.lit(0))).cast("long"))


def after_search(calls: DataFrame, session: str, order: list[str], now: Column, before: Column, back: int) -> DataFrame:
    """Calls ``now`` with a call ``before`` among the ``back`` calls before them; the last of these
    as the struct ``search`` (tokens, pattern, result)."""
    w = W.partitionBy(session).orderBy(*order).rowsBetween(-back, -1)
    one = F.when(before, F.struct(F.col("result_tokens").alias("tokens"), F.col("pattern").alias("pattern"), F.col("result").alias("result")))
    return calls.withColumn("search", F.last(one, ignorenulls=True).over(w)).where(now & F.col("search").isNotNull())


def sequence_savings(calls: DataFrame, typical: int) -> DataFrame:
    saved = F.greatest(F.lit(0), F.col("search.tokens") + F.col("result_tokens") - typical)
    t = calls.withColumn("saved", saved.cast("long")).where(F.col("saved") >= LEAST_SAVED)
    return t.withColumn("confidence", F.when(F.col("saved") > 500, F.lit(0.85)).otherwise(F.lit(0.75)))


def named_in(path: Column, result: Column) -> Column:
    """Whether a search result names the file, by its name or a longer end of its path."""
    name = F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)
    return F.coalesce((name != "") & F.contains(result, name), F.lit(False))


def multi_hop(calls: DataFrame, session: str, order: list[str]) -> DataFrame:
    """Reads of a file that a grep for a name found shortly before (columns pattern, file_path, result)."""
    t = after_search(calls, session, order, F.col("tool_name") == "Read", F.col("tool_name").isin("Grep", "grep"), GREP_BACK)
    t = t.where(identifier_like(F.col("search.pattern")) & named_in(F.col("file_path"), F.col("search.result")))
    return sequence_savings(t, GREP_TYPICAL)


def find_then_grep(calls: DataFrame, session: str, order: list[str]) -> DataFrame:
    """Greps for a name shortly after a search for files."""
    t = after_search(calls, session, order, F.col("tool_name").isin("Grep", "grep"), F.col("tool_name").isin("Glob", "find"), FIND_BACK)
    return sequence_savings(t.where(identifier_like(F.col("pattern"))), SEQUENCE_TYPICAL)


def grep_rule(pattern: Column, recursive: Column, saved: Column) -> Column:
    """Suggestion and confidence for a shell grep; null if the pattern is no name."""
    base = F.when(definition_like(pattern), F.struct(F.lit("symbols").alias("tool"), F.lit(0.75).alias("c"))).when(recursive, F.struct(F.lit("usages").alias("tool"), F.lit(0.85).alias("c"))).otherwise(F.struct(F.lit("symbol").alias("tool"), F.lit(0.70).alias("c")))
    sure = F.round(F.least(F.lit(1.0), base["c"] + F.when(saved > 500, 0.1).otherwise(0.0)), 2)
    return F.when(identifier_like(pattern) | definition_like(pattern), F.struct(base["tool"].alias("tool"), sure.alias("confidence")))


def grep_tool_rule(saved: Column, pattern: Column) -> Column:
    """Confidence for a search for a name; null for other patterns."""
    return F.when(identifier_like(pattern), F.round(F.lit(0.80) + F.when(saved > 500, 0.1).otherwise(0.0), 2))


def read_rule(path: Column, tokens: Column, partial: Column) -> Column:
    """Savings and confidence for a whole read of a code file of 500 tokens or more."""
    saved = F.greatest(F.lit(0), tokens - (STRUCTURE_BASE + F.floor(tokens * 0.3)))
    sure = F.when(tokens > 2000, 0.9).when(tokens > 1000, 0.8).otherwise(0.7)
    return F.when(F.lower(path).rlike(CODE) & (tokens >= 500) & ~partial, F.struct(saved.cast("long").alias("saved"), sure.alias("confidence")))


def find_exec_rule(tokens: Column, pattern: Column) -> Column:
    """Savings and confidence for a find that greps for a name."""
    saved = F.greatest(F.lit(0), tokens - SEQUENCE_TYPICAL)
    return F.when(identifier_like(pattern) & (saved >= 50), F.struct(saved.cast("long").alias("saved"), F.when(saved > 300, 0.8).otherwise(0.7).alias("confidence")))


def call_history(calls: DataFrame, session: str, order: list[str]) -> DataFrame:
    """With the files read and the patterns searched before each call, in order (reads, greps)."""
    w = W.partitionBy(session).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    had = lambda tool, c: F.collect_list(F.when(F.col("tool_name") == tool, F.col(c))).over(w)
    return calls.withColumn("reads", had("Read", "file_path")).withColumn("greps", had("Grep", "pattern"))


def transcript_summary(calls: DataFrame, opportunities: DataFrame, key: str) -> DataFrame:
    """(key, calls, tokens, tools, commands, saved, saved_pct): counts by tool and by shell command
    as sorted arrays, and what the opportunities (key, saved) would save."""

    def counts(column: str, name: str) -> DataFrame:
        n = calls.where(F.col(column).isNotNull()).groupBy(key, column).agg(F.count("*").alias("n"))
        return n.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(column).alias("k"), "n"))).alias(name))

    t = calls.groupBy(key).agg(F.count("*").alias("calls"), F.sum("result_tokens").cast("long").alias("tokens"))
    t = t.join(counts("tool_name", "tools"), key, "left").join(counts("command_type", "commands"), key, "left")
    t = t.join(opportunities.groupBy(key).agg(F.sum("saved").cast("long").alias("saved")), key, "left").withColumn("saved", F.coalesce("saved", F.lit(0)).cast("long"))
    return t.withColumn("saved_pct", F.when(F.col("tokens") > 0, F.col("saved") * 100.0 / F.col("tokens")).otherwise(F.lit(0.0)))


def distribution(calls: DataFrame, keys: list[str]) -> DataFrame:
    return calls.groupBy(*keys).agg(F.count("*").alias("calls"), F.sum("result_tokens").cast("long").alias("tokens"))


def shell_info(command: str | None) -> tuple[str, str | None, str | None, bool, list[str]]:
    """(type, pattern, path, recursive, flags) of a shell command; words are split as a shell does,
    or at blanks if quotes do not close."""
    try:
        words = shlex.split(command or "")
    except ValueError:
        words = (command or "").split()
    if not words:
        return "other", None, None, False, []
    name = words[0].rpartition("/")[2]
    flags = [w for w in words[1:] if w.startswith("-") and len(w) > 1]
    rest = [w for w in words[1:] if not w.startswith("-")]
    if name in ("grep", "egrep", "fgrep", "rg", "ag"):
        recursive = name in ("rg", "ag") or any(f in ("--recursive",) or (not f.startswith("--") and ("r" in f or "R" in f)) for f in flags)
        return "grep", rest[0] if rest else None, rest[1] if len(rest) > 1 else None, recursive, flags
    if name == "find":
        if "-exec" in words:
            tail = words[words.index("-exec") + 1 :]
            if tail and tail[0].rpartition("/")[2] in ("grep", "egrep"):
                found = [w for w in tail[1:] if not w.startswith("-") and w not in ("{}", ";", "+", "\\;")]
                return "find", found[0] if found else None, rest[0] if rest else None, True, flags
        named = next((words[i + 1] for i, w in enumerate(words[:-1]) if w in ("-name", "-iname", "-path")), None)
        return "find", named, rest[0] if rest and rest[0] != named else None, True, flags
    if name in ("cat", "head", "tail", "less", "more"):
        return "read", None, next((w for w in reversed(rest) if not w.isdigit()), None), False, flags
    if name in ("ls", "tree"):
        return "list", None, rest[0] if rest else None, name == "tree" or any("R" in f for f in flags), flags
    return name if name in ("git", "sed", "awk") else "other", None, None, False, flags


def classified(commands: DataFrame, column: str = "command") -> DataFrame:
    """``commands`` with the parts of the shell command, in Arrow batches."""
    schema = "command_type string, pattern string, target_path string, is_recursive boolean, flags array<string>"

    @F.pandas_udf(schema)
    def parse(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shell_info(x) for x in s], columns=["command_type", "pattern", "target_path", "is_recursive", "flags"])

    return commands.withColumn("info", parse(column))
