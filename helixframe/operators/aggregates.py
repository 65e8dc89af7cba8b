"""Grouping, pivots, ranking, paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranges


def frequencies(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def frequent(df: DataFrame, over: int, *keys: str) -> DataFrame:
    return frequencies(df, *keys).where(F.col("n") > over)


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return frequent(df, 1, *keys)


def size_distribution(df: DataFrame, key: str) -> DataFrame:
    """How many groups have each size."""
    return df.groupBy(key).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n"))


def histogram(df: DataFrame, column: str, width: float, *keys: str) -> DataFrame:
    return df.groupBy(*keys, F.floor(F.col(column) / width).alias("bin")).agg(F.count("*").alias("n"))


def pivot_counts(df: DataFrame, rows: list[str], column: str, values: list, total: Column | None = None) -> DataFrame:
    """Counts (or the total) per row key and given column value; 0 where there is none."""
    out = df.groupBy(*rows).pivot(column, values).agg(F.count(F.lit(1)) if total is None else total)
    return out.fillna(0, subset=[str(v) for v in values])


def statistics(df: DataFrame, column: str, *keys: str) -> DataFrame:
    c = F.col(column)
    return df.groupBy(*keys).agg(F.round(F.avg(c), 6).alias("mean"), F.median(c).alias("median"), F.min(c).alias("least"), F.max(c).alias("most"), F.count("*").alias("n"))


def latest(df: DataFrame, key: str | list[str], *order: str) -> DataFrame:
    """The last row per key by the order columns (W2, W8): a ranking that Spark cuts per task before it shuffles."""
    keys = [key] if isinstance(key, str) else key
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def latest_of_major(df: DataFrame, record: str, version: str) -> DataFrame:
    """The greatest version, as text, per record and first character."""
    return latest(df.withColumn("major", F.substring(version, 1, 1)), [record, "major"], version)


def best_ranked(df: DataFrame, key: str, value: str, order: list[str], tie: str) -> DataFrame:
    """The row with the highest-ranked value per key, and whether the key has several rows."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col(value)), F.lit(0)), F.lit(len(order) + 1))
    w = Window.partitionBy(key)
    return df.withColumn("_k", F.row_number().over(w.orderBy(rank, tie))).withColumn("several", F.count("*").over(w) > 1).where("_k = 1").drop("_k")


def running_total(df: DataFrame, by: str, total: str = "n", *keys: str) -> DataFrame:
    """Cumulative totals in order of `by`, per key or over all rows, in two passes over range partitions."""
    return ranges.running_total(df, [by], total, keys=list(keys))


def top(df: DataFrame, n: int, by: str, *ties: str, ascending: bool = False) -> DataFrame:
    return df.orderBy(F.asc(by) if ascending else F.desc(by), *ties).limit(n)


def top_and_other(counts: DataFrame, n: int, key: str, by: str = "n") -> DataFrame:
    """The n largest groups and one group 'other' (L5)."""
    first = counts.select(key, by).orderBy(F.desc(by), key).limit(n)
    rest = counts.join(first.select(F.col(key).alias("_top")), F.col(key).eqNullSafe(F.col("_top")), "left_anti").agg(F.sum(by).alias(by))
    return first.unionByName(rest.where(F.col(by).isNotNull()).select(F.lit("other").alias(key), by))


SORTS = {"GENE_LABEL": "gene_label", "DISEASE_LABEL": "disease_label", "REPORT_DATE": "report_date"}


def page(df: DataFrame, limit: int, offset: int = 0, field: str = "GENE_LABEL", descending: bool = False, tie: str = "iri", sorts: dict[str, str] = SORTS) -> tuple[DataFrame, DataFrame]:
    """One page, and the total count as a one-row table (L1)."""
    c = F.col(sorts[field])
    return df.orderBy(c.desc() if descending else c.asc(), tie).offset(offset).limit(limit), df.agg(F.count("*").alias("count"))


def page_after(df: DataFrame, limit: int, after: tuple | None = None, field: str = "GENE_LABEL", descending: bool = False, tie: str = "iri", sorts: dict[str, str] = SORTS) -> DataFrame:
    """The page that follows a row, given by its sort value and tie (L1, G14): all pages together are the list of page(), and none reads what an earlier one showed.

    Ties are unique and not null; null sort values come first upwards, last downwards. The condition on the sort column
    stands by itself too, so that it reaches the scan.
    """
    column, unique = sorts[field], F.col(tie)
    c = F.col(column)
    if after is not None:
        value, last = after
        if value is None:
            rest = (c.isNull() & (unique > last)) if descending else (c.isNotNull() | (unique > last))
        elif descending:
            rest = ((c <= value) & ((c < value) | (unique > last))) | c.isNull()
        else:
            rest = (c >= value) & ((c > value) | (unique > last))
        df = df.where(rest)
    return df.orderBy(c.desc() if descending else c.asc(), tie).limit(limit)


def cursor(page: DataFrame, field: str = "GENE_LABEL", tie: str = "iri", sorts: dict[str, str] = SORTS) -> tuple | None:
    """Sort value and tie of a page's last row, for page_after(); None after an empty page."""
    rows = page.select(sorts[field], tie).collect()  # a page's rows
    return tuple(rows[-1]) if rows else None


def version_list(df: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """Versions in order as an array of structs."""
    return df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, *columns))).alias("versions"))
