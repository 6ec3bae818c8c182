"""Lines and columns of offsets in bulk, and the text around them, by joins with a table of lines.

The table of lines is made once for all texts. An offset finds its line by a join of cells
(``narrowest``), so that a large file's lines are spread and no array of them is walked for each offset.

Edge cases: null texts have no lines, empty ones have one that is empty; an offset at a line's end or at the
end of the text is on that line; offsets outside of a text, or of a file without one, have no line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .joins import narrowest


def line_table(sources: DataFrame, in_bytes: bool = True) -> DataFrame:
    """(file, line, start_pos, end_pos, text): the lines of (path, content), numbered from 1; positions are
    bytes or characters, and a line ends behind its line feed, the last one behind its text's end."""
    rows = sources.select(F.col("path").cast("string").alias("file"), F.posexplode(F.split(F.col("content").cast("string"), "\n", -1)).alias("i", "text"))
    # sizes are taken before the window, so that who needs no texts exchanges none
    rows = rows.withColumn("size", (F.octet_length("text") if in_bytes else F.length("text")) + 1)
    end = F.sum(F.col("size").cast("long")).over(W.partitionBy("file").orderBy("i"))
    return rows.select("file", (F.col("i") + 1).cast("long").alias("line"), (end - F.col("size")).alias("start_pos"), end.alias("end_pos"), "text")


def located(probes: DataFrame, lines: DataFrame, key: str = "probe_id") -> DataFrame:
    """(key, file, offset, line, col): line and column, both from 1, of probes (key, file, offset)."""
    spans = lines.select("file", "start_pos", "end_pos", F.struct("line", "start_pos").alias("id"))
    found = narrowest(probes, spans, key).select(key, F.col("id.line").alias("line"), F.col("id.start_pos").alias("_start"))
    return probes.join(found, key, "left").select(key, "file", "offset", "line", (F.col("offset") - F.col("_start") + 1).cast("long").alias("col"))


def with_context(found: DataFrame, lines: DataFrame, around: int = 0, key: str = "probe_id") -> DataFrame:
    """(key, first_line, snippet): the line of each located probe with up to ``around`` lines on both sides.

    A line gets those around it once, where the lines of its file stand together, and not for each probe: what
    is exchanged grows with the lines, however many probes each has.
    """
    near = W.partitionBy("file").orderBy("line").rowsBetween(-around, around)
    rows = lines.select("file", "line", F.min("line").over(near).alias("first_line"), F.array_join(F.collect_list("text").over(near), "\n").alias("snippet"))
    wanted = found.where("line is not null").select(key, "file", "line")
    return wanted.join(rows, ["file", "line"]).select(key, "first_line", "snippet")
