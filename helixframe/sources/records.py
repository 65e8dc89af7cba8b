"""Records of large text files by scans that Spark splits (S1, S2): no file is read as one string.

The text source cuts files at a delimiter, the beginning of an element's start tag or any other fixed text. A file's
ranges go to many tasks, and a piece that crosses the end of a range is read whole by the task in whose range it begins.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ranges

_ATTRIBUTES = r"""(?:/|\s(?:[^<>"']++|"[^"]*+"|'[^']*+')*+)?"""


def split_chunks(spark: SparkSession, path: str, delimiter: str, record: str) -> DataFrame:
    """(record): files cut before each delimiter, which stays with what follows it, and of each piece the first match of the pattern (S2); pieces without one are left out."""
    chunks = spark.read.option("lineSep", delimiter).text(path).select(F.concat(F.lit(delimiter), "value").alias("chunk"))
    return chunks.select(F.regexp_substr("chunk", F.lit(record)).alias("record")).where("record is not null")


def split_records(spark: SparkSession, path: str, tag: str, simple: bool = False) -> DataFrame:
    """(record): whole elements of a tag as text, tags kept, those without content (<tag/>) among them.

    Elements may stand inside each other: the outermost are given out. A file is cut before every start tag; the depth
    after each piece is a running total over its file, in range partitions, and a record's pieces are put together by
    its number, so a task holds records, never a file. simple promises that an element holds neither another one nor a
    tag whose name begins with this one's: then a piece goes to its first end tag, and nothing is shuffled. Elements
    without an end are left out. Tags inside comments and quoted sections are taken as tags; attribute values may hold
    angle brackets, if not the tag itself.
    """
    t = re.escape(tag)
    alone, full = rf"^<{t}{_ATTRIBUTES}(?<=/)>", rf"^<{t}{_ATTRIBUTES}(?<!/)>"
    if simple:
        return split_chunks(spark, path, f"<{tag}", rf"(?s){alone}|{full}.*?</{t}>")
    chunks = spark.read.option("lineSep", f"<{tag}").text(path).select(
        F.concat(F.lit(f"<{tag}"), "value").alias("chunk"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")
    )
    holds = lambda pattern: F.rlike("chunk", F.lit(pattern))
    ends = F.regexp_count("chunk", F.lit(f"</{t}>"))
    steps = ranges.written(chunks.withColumns({"opens": holds(full).cast("int"), "alone": holds(alone), "ends": ends}), "chunks")
    deep = ranges.running_total(steps.select("file", "block", "at", (F.col("opens") - F.col("ends")).alias("step")), ["block", "at"], "step", "after", ["file"])
    # a record begins where the depth before its piece is 0, and ends with the piece that brings it back to 0
    deep = deep.withColumn("begins", F.when(F.col("after") - F.col("step") == 0, 1).otherwise(0))
    numbered = ranges.running_total(deep, ["block", "at"], "begins", "n", ["file"])
    parts = steps.join(numbered.select("file", "block", "at", "n", "after"), ["file", "block", "at"])
    # a record's pieces meet by its number: as many bytes as the record has
    ordered = F.sort_array(F.collect_list(F.struct("block", "at", "chunk", "opens", "alone")))
    joined = parts.groupBy("file", "n").agg(ordered.alias("parts"), F.min("after").alias("least"))
    first = F.element_at("parts", 1)
    text = F.array_join(F.col("parts")["chunk"], "")
    whole = F.when(first["alone"], F.regexp_substr(text, F.lit(alone))).when((first["opens"] == 1) & (F.col("least") <= 0), F.regexp_substr(text, F.lit(rf"(?s)^.*</{t}>")))
    return joined.select(whole.alias("record")).where("record is not null")
