"""Operator 12: how filters interact, from sorted posting lists of failing ids.

Every row gets a number: rows are put in the order of (part, key) over range partitions, so a part that holds a third of
all rows lies in many of them, and numbered within their block of at most `block` rows of one part. A block keeps for each
filter the sorted numbers of the rows that fail it (its posting list), and the like for marks such as "good" or "toxic".
The lists are written; the audit reads nothing else.

Unions and differences come from galloping: the ids of the shorter list leap through the longer, bracketed by doubling
steps and then found by binary search, one id range after the other; a union of k lists takes the shortest lists first.
A block yields for every set S of filters and every further filter f the sizes of fail(f) minus union(S) and of its
meetings with the marks; sizes add up over blocks. Orders are sums of these: what f removes after S is fail(f) minus
union(S), whatever the order within S.

Sets are 2^n for n filters (n is 5 in the query, 12 at most), lists are at most a block long, and what is shuffled after
the lists is one row per block and set, added up per task first.

Defined results: a null part counts as the empty string; a null text as empty; rows with null or repeated keys are rows
of their own; a null key is never a copy of a smaller one nor marked; of equal texts those with the smallest key stay
(all rows that bear it). Keys of marks may repeat: one marked row is enough. An empty table gives an empty result.
Columns of the input that aren't named are not read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, stored

BLOCK = 65_536
MOST_FILTERS = 12

_WORD = r"[^\x20\x09-\x0D]+"


def quality_filters(text: str = "text") -> dict[str, Column]:
    """The conditions under which a text fails: few words, repeated words, capitals, odd characters."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.regexp_extract_all(t, F.lit(_WORD), F.lit(0))
    n = F.size(words)
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * n,
        "C": 100 * F.length(F.regexp_replace(t, "[^A-Z]+", "")).cast("long") > 2 * F.length(t).cast("long"),
        "D": F.rlike(t, F.lit("[#$%&*|]")),
    }


def later_copies(rows: DataFrame, key: str, digest: str, out: str) -> DataFrame:
    """rows with a flag: an equal digest has a smaller key somewhere in the table.

    The smallest keys are aggregated per task first and written; only digests of several keys are joined, as a plain
    shuffle that AQE can split at a hot text.
    """
    first = stored(rows.groupBy(digest).agg(F.min(key).alias("_first"), F.max(key).alias("_last")).where("_first < _last").select(digest, "_first"), "first-copies")
    return rows.join(first, digest, "left").withColumn(out, F.coalesce(F.col(key) > F.col("_first"), F.lit(False))).drop("_first")


def leap(ids: np.ndarray, targets: np.ndarray, step: int = 1024) -> np.ndarray:
    """For sorted targets the first places in sorted ids that aren't smaller: range by range, each range bracketed from
    where the one before ended by doubling steps, then searched."""
    out = np.empty(len(targets), np.int64)
    at = 0
    for a in range(0, len(targets), step):
        last = targets[min(a + step, len(targets)) - 1]
        end, width = at, 1
        while end < len(ids) and ids[end] < last:
            end, width = end + width, width * 2
        end = min(end + 1, len(ids))
        out[a : a + step] = at + np.searchsorted(ids[at:end], targets[a : a + step])
        at = int(out[min(a + step, len(targets)) - 1])
    return out


def _among(shorter: np.ndarray, longer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the shorter list's ids stand in the longer one, and whether they are there."""
    at = leap(longer, shorter)
    there = np.zeros(len(shorter), bool)
    inside = at < len(longer)
    there[inside] = longer[at[inside]] == shorter[inside]
    return at, there


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ids in both sorted lists."""
    shorter, longer = (a, b) if len(a) <= len(b) else (b, a)
    return shorter[_among(shorter, longer)[1]]


def difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ids of a that aren't in b."""
    if len(a) <= len(b):
        return a[~_among(a, b)[1]]
    at, there = _among(b, a)
    keep = np.ones(len(a), bool)
    keep[at[there]] = False
    return a[keep]


def union(lists: list[np.ndarray]) -> np.ndarray:
    """Ids in any of the sorted lists, sorted; the shortest lists are merged first."""
    lists = sorted(lists, key=len)
    out = lists[0] if lists else np.empty(0, np.int32)
    for longer in lists[1:]:
        shorter, longer = (out, longer) if len(out) <= len(longer) else (longer, out)
        at, there = _among(shorter, longer)
        out = np.insert(longer, at[~there], shorter[~there])
    return out


def posting_lists(rows: DataFrame, part: str, key: str, filters: list[str], marks: list[str], block: int = BLOCK) -> DataFrame:
    """(part, block, n_rows, one sorted array of row numbers per filter and mark): the flags of rows as posting lists.

    rows has boolean columns named by filters and marks; block numbers are unique within a part.
    """
    names = [*filters, *marks]
    flags = [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in names]
    chosen = rows.select(F.coalesce(F.col(part), F.lit("")).alias("part"), F.col(key).alias("key"), *flags)
    n = max(1, min(20_000, math.ceil(chosen.count() / (2 * block))))
    n = max(n, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # equal keys, null ones among them, are split by a hash of their flags and a number dealt out within the input's tasks
    ordered = chosen.withColumn("salt", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(n, "part", "key", "salt").sortWithinPartitions("part", "key", "salt").drop("salt", "key")
    schema = "part string, block long, n_rows long, " + ", ".join(f"`{c}` array<int>" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId() << 32
        number, now, size = 0, None, 0
        held: list[list[np.ndarray]] = [[] for _ in names]

        def lists() -> pa.RecordBatch:
            columns = [pa.array([np.concatenate(x) if x else np.empty(0, np.int32)], pa.list_(pa.int32())) for x in held]
            return pa.RecordBatch.from_arrays([pa.array([now], pa.string()), pa.array([task + number], pa.int64()), pa.array([size], pa.int64()), *columns], ["part", "block", "n_rows", *names])

        for b in batches:
            if not b.num_rows:
                continue
            parts = b.column(0)
            code = parts.dictionary_encode().indices.to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), b.num_rows]
            failing = [np.flatnonzero(b.column(1 + i).to_numpy(zero_copy_only=False)).astype(np.int32) for i in range(len(names))]
            for a, z in zip(cuts, cuts[1:], strict=False):
                here = parts[a].as_py()
                while a < z:
                    if now is not None and (here != now or size >= block):
                        yield lists()
                        number, size, held = number + 1, 0, [[] for _ in names]
                    now = here
                    end = min(z, a + block - size)
                    for x, ids in zip(held, failing, strict=True):
                        lo, hi = np.searchsorted(ids, [a, end])
                        x.append(ids[lo:hi] - np.int32(a - size))
                    size, a = size + end - a, end
        if size:
            yield lists()
        give_back()

    return ordered.mapInArrow(run, schema)


def set_sizes(postings: DataFrame, filters: list[str], marks: list[str]) -> DataFrame:
    """(part, filter, earlier, n_rows, fails, gone, new, new_<mark>): for each filter and each set of other filters
    (a bit for each of filters), summed over blocks: rows that fail it, rows that fail any of the set, rows that fail it
    and none of the set, and how many of these bear the mark."""
    n = len(filters)
    if n > MOST_FILTERS:
        raise ValueError(f"{n} filters make 2^{n} sets; {MOST_FILTERS} is the most")
    numbers = ["n_rows", "fails", "gone", "new", *[f"new_{m}" for m in marks]]
    sets = [(f, s) for s in range(1 << n) for f in range(n) if not s >> f & 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}

        def rows() -> pa.RecordBatch:
            parts = list(totals)
            table = np.concatenate([totals[p] for p in parts])
            which = np.tile(np.array(sets, np.int32).reshape(-1, 2), (len(parts), 1))
            names = pa.array(np.repeat(np.array(parts, object), len(sets)), pa.string())
            return pa.RecordBatch.from_arrays([names, pa.array([filters[f] for f in which[:, 0]]), pa.array(which[:, 1]), *[pa.array(c) for c in table.T]], ["part", "filter", "earlier", *numbers])

        for b in batches:
            for i in range(b.num_rows):
                part, size = b.column(0)[i].as_py(), b.column(2)[i].as_py()
                lists = [b.column(3 + j)[i].values.to_numpy() for j in range(n)]
                marked = [b.column(3 + n + j)[i].values.to_numpy() for j in range(len(marks))]
                out = np.empty((len(sets), len(numbers)), np.int64)
                earlier, at = -1, None
                for row, (f, s) in enumerate(sets):
                    if s != earlier:
                        earlier, at = s, union([lists[j] for j in range(n) if s >> j & 1])
                    new = difference(lists[f], at)
                    out[row] = (size, len(lists[f]), len(at), len(new), *[len(common(new, m)) for m in marked])
                totals[part] = totals[part] + out if part in totals else out
                if len(totals) >= 200:
                    yield rows()
                    totals = {}
        if totals:
            yield rows()
        give_back()

    schema = "part string, filter string, earlier int, " + ", ".join(f"{c} long" for c in numbers)
    return postings.mapInArrow(run, schema).groupBy("part", "filter", "earlier").agg(*[F.sum(c).alias(c) for c in numbers])


def interactions(sizes: DataFrame, filters: list[str], marks: dict[str, str]) -> DataFrame:
    """One row per part, order of the filters and step: kept, removed, redundant, unique_fails, a count for each mark (mark -> its column), shapley.

    Orders are all permutations: n! x n rows a part, so n is 7 at most here.
    """
    n = len(filters)
    if n > 7:
        raise ValueError(f"{n} filters have too many orders to list")
    steps = [("".join(order), k + 1, f, sum(1 << filters.index(x) for x in order[:k])) for order in itertools.permutations(filters) for k, f in enumerate(order)]
    spark = sizes.sparkSession
    orders = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, filter string, earlier int"))
    # how many orders have exactly the set before the filter
    before = F.bit_count("earlier")
    ways = F.element_at(F.lit([math.factorial(k) * math.factorial(n - 1 - k) for k in range(n)]), before + 1)
    whole = F.sum(F.when(before == n - 1, F.col("new"))).alias("unique_fails")
    own = sizes.groupBy("part", "filter").agg(whole, F.sum(ways * F.col("new")).alias("shapley"))
    told = sizes.join(orders, ["filter", "earlier"]).join(own, ["part", "filter"])
    return told.select(
        "part", "filter_order", "step", (F.col("n_rows") - F.col("gone") - F.col("new")).alias("kept"), F.col("new").alias("removed"),
        (F.col("fails") - F.col("new")).alias("redundant"), "unique_fails", *[F.col(f"new_{m}").alias(c) for m, c in marks.items()], "shapley",
    )


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """The five filters of the query over whole texts: A-D by quality_filters(), E by later_copies()."""
    filters, marks = list("ABCDE"), ["good", "toxic"]
    rows = docs.select(F.col(key).alias("key"), F.col(part).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")
    rows = stored(rows.select("key", "part", digest, *[c.alias(f) for f, c in quality_filters().items()]), "filter-flags")
    rows = later_copies(rows, "key", "digest", "E").drop("digest")
    told = stored(labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")), "marks")
    rows = stored(rows.join(told, "key", "left"), "flagged")
    postings = stored(posting_lists(rows, "part", "key", filters, marks), "postings")
    sizes = stored(set_sizes(postings, filters, marks), "set-sizes")
    return interactions(sizes, filters, {"good": "good_lost", "toxic": "toxic_lost"})


def oracle() -> str:
    """DuckDB SQL for audit(): counts by the set of filters that a row fails."""
    orders = ", ".join(f"('{''.join(o)}')" for o in itertools.permutations("ABCDE"))
    return rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (SELECT *, regexp_extract_all(t, '{_WORD}') AS words, min(doc_id) OVER (PARTITION BY t) AS first FROM d
), l AS (SELECT doc_id, coalesce(max(quality = 1), false) AS good, coalesce(max(toxic = 1), false) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         [CASE WHEN len(words) < 200 THEN 'A' END, CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' END,
          CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t) THEN 'C' END,
          CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END, CASE WHEN w.doc_id > first THEN 'E' END] AS fails
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id
), g AS (SELECT part, list_filter(fails, lambda x: x IS NOT NULL) AS fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f GROUP BY ALL
), o AS (SELECT * FROM (VALUES {orders}) AS x(filter_order)
), steps AS (
  SELECT o.filter_order, s.step, substr(o.filter_order, s.step, 1) AS filter, string_split(substr(o.filter_order, 1, s.step - 1), '') AS earlier
  FROM o, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step) s
), each AS (
  SELECT g.part, filter_order, step, filter, sum(n) AS n,
         coalesce(sum(n) FILTER (WHERE list_has_any(fails, earlier)), 0) AS gone,
         coalesce(sum(n) FILTER (WHERE list_contains(fails, filter)), 0) AS failing,
         coalesce(sum(n) FILTER (WHERE list_contains(fails, filter) AND NOT list_has_any(fails, earlier)), 0) AS removed,
         coalesce(sum(n) FILTER (WHERE fails = [filter]), 0) AS unique_fails,
         coalesce(sum(good) FILTER (WHERE list_contains(fails, filter) AND NOT list_has_any(fails, earlier)), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (WHERE list_contains(fails, filter) AND NOT list_has_any(fails, earlier)), 0) AS toxic_lost
  FROM g, steps GROUP BY ALL
)
SELECT part, filter_order, step, CAST(n - gone - removed AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(failing - removed AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM each
"""
