"""Comparing the members of buckets in blocks, and connected components: what the near-duplicate operators share.

A bucket of n members is split by id hash into about n/block parts; every pair of parts (and every part with itself) is
a unit of work of its own, so a hot bucket spreads over the cluster. A unit returns per member the links found and one
member it hangs together with, never its pairs: output grows with members, not with pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forest_roots, give_back, runs, stored

LINKS = "id long, links long, root long"

#: From the payload columns of two member index arrays to the linked pairs among left x right: two index arrays.
Compare = Callable[[pa.RecordBatch, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def blocked_links(rows: DataFrame, payload: DataFrame, compare: Compare, block: int, weight: str = "weight") -> DataFrame:
    """Links within buckets.

    rows: (key, id), distinct longs. payload: one row per id, with a weight (how many rows the member stands for).
    compare gets a unit's payload and its left and right members (the same array twice for a part with itself; then
    pairs i < j are asked for). The result has a row per unit and member with links: id, links (the partners' weights),
    root (the smallest id of its group within the unit).
    """
    counts = stored(rows.groupBy("key").count().where("count > 1"), "bucket-sizes")
    parts = F.ceil(F.col("count") / block).cast("int")
    dealt = rows.join(counts, "key").select("key", "id", parts.alias("parts")).withColumn("mine", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = dealt.select("key", "id", "mine", other.alias("other")).select("key", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), "mine", "id")
    names = [c for c in payload.columns if c != "id"]
    units = dealt.join(payload, "id").select("key", "p", "q", "mine", "id", *names).repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    w = names.index(weight) + 5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in runs(batches, 3):
            p, q = b.column(1)[0].as_py(), b.column(2)[0].as_py()
            mine, ids = b.column(3).to_numpy(), b.column(4).to_numpy()
            left, right = np.flatnonzero(mine == p), np.flatnonzero(mine == q)
            if not len(left) or not len(right) or (p == q and len(left) < 2):
                continue
            i, j = compare(b, left, right)
            if not len(i):
                continue
            weights = b.column(w).to_numpy().astype(np.float64)
            links = np.bincount(i, weights[j], len(ids)) + np.bincount(j, weights[i], len(ids))
            order = np.argsort(ids, kind="stable")  # roots are smallest ids: work on ranks
            rank = np.empty(len(ids), np.int64)
            rank[order] = np.arange(len(ids))
            root = ids[order][forest_roots(len(ids), rank[i], rank[j])[rank]]
            has = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(ids[has], pa.int64()), pa.array(links[has].astype(np.int64)), pa.array(root[has], pa.int64())], ["id", "links", "root"])
        give_back()

    return units.mapInArrow(run, LINKS)


def components(edges: DataFrame, what: str, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of the edges (a, b) reaches.

    Alternating rounds: every node hands its larger neighbours, then its smaller ones, to the smallest it knows. The
    edges become stars in a number of rounds that grows with the logarithm of the longest path. Minima are aggregated
    per task first and written before they are joined, so the join's two sides are plain shuffles that AQE can split
    at a hot node. Each round is written to the shared folder.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    e = stored(e, f"{what}-edges")
    before = None
    for _ in range(max_rounds):
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        low = stored(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), f"{what}-low")
        e = both.where("v > u").join(low, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        e = stored(e, f"{what}-large")
        low = stored(e.groupBy("hi").agg(F.min("lo").alias("m")), f"{what}-low")
        small = e.join(low, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        e = stored(small.unionAll(low.select("hi", F.col("m").alias("lo"))).distinct(), f"{what}-small")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components did not settle")
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
