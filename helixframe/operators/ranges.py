"""Running totals and neighbours in order without a single task (W1, ST5): windows over range partitions.

Rows are put in order over range partitions and written, so that a partition's number is part of the row. Then a window
runs inside each (partition, key), and one row for each of these says what the partitions before (or after) it add. A
key that holds a third of all rows lies in many partitions and is summed by as many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.sinks import shared_folder


def written(df: DataFrame, what: str) -> DataFrame:
    """df written to a new shared folder and read again."""
    path = shared_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_ranges(df: DataFrame, keys: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """df with the number of its range partition (_range) in the order of keys and order columns; equal ones are split too."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = df.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id()))
    dealt = salted.repartitionByRange(n, *keys, *order, "_salt").withColumn("_range", F.spark_partition_id())
    return written(dealt, "ranges")


def running_total(df: DataFrame, order: list[str], value: str, out: str = "total", keys: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """df with the sum of value over the rows up to and including its own, per key, in the order of the order columns (two passes: sums of ranges, then sums within).

    Rows of equal order stand in any fixed sequence; with a total order results are unique. Null values count as nothing.
    """
    keys = keys or []
    rows = in_ranges(df, keys, order, parts)
    sums = rows.groupBy("_range", *keys).agg(F.sum(value).alias("_sum"))
    if keys:  # one row per (range, key): a key's rows here are as many as its ranges
        before = sums.withColumn("_before", F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)))
    else:  # one row per range: as many as partitions, whatever the rows
        total, told = None, []
        for r, x in sorted(sums.collect()):
            told.append((r, total))
            total = x if total is None else total if x is None else total + x
        before = F.broadcast(df.sparkSession.createDataFrame(told, T.StructType([sums.schema["_range"], T.StructField("_before", sums.schema["_sum"].dataType)])))
    before = before.select(F.col("_range").alias("_r"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_before")
    on = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = rows.join(before, on, "left").drop("_r", *[f"_k{i}" for i in range(len(keys))])
    inside = Window.partitionBy("_range", *keys).orderBy(*order, "_salt").rowsBetween(Window.unboundedPreceding, 0)
    total = F.coalesce(F.col("_before"), F.lit(0)) + F.coalesce(F.sum(value).over(inside), F.lit(0))
    return joined.withColumn(out, total.cast(sums.schema["_sum"].dataType)).drop("_salt", "_range", "_before")


def following(df: DataFrame, key: str, order: list[str], column: str, out: str, parts: int | None = None) -> DataFrame:
    """df with the column's value in the key's next row by the order columns, null in its last one; a hot key's rows are spread over ranges."""
    rows = in_ranges(df, [key], order, parts)
    head = F.struct(*order, "_salt")
    firsts = rows.groupBy("_range", key).agg(F.min_by(F.struct(F.col(column).alias("v")), head).alias("_first"))
    after = firsts.withColumn("_after", F.lead("_first").over(Window.partitionBy(key).orderBy("_range"))).select(F.col("_range").alias("_r"), F.col(key).alias("_k"), "_after")
    joined = rows.join(after, (F.col("_range") == F.col("_r")) & F.col(key).eqNullSafe(F.col("_k")), "left").drop("_r", "_k")
    here = F.lead(F.struct(F.col(column).alias("v"))).over(Window.partitionBy("_range", key).orderBy(*order, "_salt"))
    return joined.withColumn("_next", F.coalesce(here, F.col("_after"))).withColumns({out: F.col("_next")["v"], "_is_last": F.col("_next").isNull()}).drop("_salt", "_range", "_after", "_next")
