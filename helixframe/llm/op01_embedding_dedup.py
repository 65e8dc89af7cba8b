"""Operator 1: embedding near-duplicates by random-hyperplane sign hashing, exact cosine and connected components.

Vectors with equal labels and equal components are one class, counted before anything is compared. A class gets one sign
code per table (bits hyperplanes each); classes that share label, table and code are candidates. Codes grow with the
logarithm of the input, so buckets stay small; the number of tables follows from the wanted recall at the threshold.
Buckets of one member are dropped before any vector is shuffled. Candidates are compared in blocks by cosine in double
precision; a pair that already met in an earlier table is left to that table, so every link counts once. Links inside a
unit come out as counts and a group root, and components run over classes.

Work is near linear where vectors differ; inside one group of near-identical but unequal vectors it is quadratic in the
group, as exact link counts need every pair to be looked at, but spread over units of block x block vectors.

Defined results: vectors that are null, zero, or hold null or non-finite components, and rows with a null label, link
with nothing; vectors of different lengths link with nothing; equal vectors link with each other; a null id comes back
with null component; repeated rows are vectors of their own; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import blocked_links, components
from .common import give_back, stored


@dataclass(frozen=True)
class Params:
    threshold: float = 0.93
    recall: float = 0.999
    spare_bits: int = 2
    block: int = 256
    seed: int = 20_240


def shape(rows_per_label: int, p: Params) -> tuple[int, int]:
    """Bits per code and number of tables: codes have spare_bits more bits than the largest label needs to number its rows."""
    bits = min(30, max(8, math.ceil(math.log2(max(rows_per_label, 2))) + p.spare_bits))
    agree = (1 - math.acos(p.threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - p.recall) / math.log(1 - agree))


def sign_codes(x: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """Codes (rows x tables) of vectors."""
    planes = np.random.default_rng([seed, x.shape[1]]).standard_normal((x.shape[1], bits * tables))
    signs = (x @ planes >= 0).reshape(len(x), tables, bits)
    return (signs * (1 << np.arange(bits))).sum(axis=2).astype(np.int32)


def near_duplicates(vectors: DataFrame, params: Params = Params(), key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """key, n_links, component_id, kept: one row per row of vectors."""
    p = params
    rows = vectors.select(F.col(key).cast("long").alias("k"), F.col(vector).alias("v"), F.col(label).alias("l"))
    good = F.col("l").isNotNull() & F.coalesce(F.size("v") > 0, F.lit(False)) & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("good", good).withColumn("c1", F.when(F.col("good"), F.xxhash64("l", "v"))).withColumn("c2", F.when(F.col("good"), F.xxhash64(F.lit(1), "v", "l")))
    # Two 64-bit hashes stand for label and components; the class is numbered by a hash of both.
    classes = stored(rows.where("good").groupBy("c1", "c2").agg(F.min("k").alias("least"), F.count("*").alias("weight"), F.any_value("l").alias("l"), F.any_value("v").alias("v")).select(F.xxhash64("c1", "c2").alias("id"), "c1", "c2", "least", "weight", F.xxhash64("l", F.size("v")).alias("l"), F.col("v").cast("array<double>").alias("v")), "classes")
    largest = classes.groupBy("l").count().agg(F.max("count")).first()[0] or 0
    bits, tables = shape(largest, p)

    def codes(batches):
        for b in batches:
            ids, labels = b.column(0).to_numpy(), b.column(1).to_numpy()
            lists = b.column(3)
            sizes = np.diff(lists.offsets.to_numpy())
            flat, at = lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(sizes)))
            out = np.zeros((len(ids), tables), np.int32)
            norms = [None] * len(ids)
            for n in np.unique(sizes):
                which = np.flatnonzero(sizes == n)
                x = flat[(at[which][:, None] + np.arange(n))].astype(np.float64)
                x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow in the norm
                x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
                out[which] = sign_codes(x, bits, tables, p.seed)
                for i, row in zip(which.tolist(), x, strict=True):
                    norms[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([r.tobytes() for r in out], pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, tables), pa.int32()), pa.array(out.ravel())), pa.array(norms, pa.binary())], ["id", "l", "weight", "codes", "each", "unit"])
        give_back()

    coded = stored(classes.select("id", "l", "weight", "v").mapInArrow(codes, "id long, l long, weight long, codes binary, each array<int>, unit binary"), "codes")
    buckets = coded.select("id", "l", F.posexplode("each").alias("t", "c"))
    # the table's number is the low bits of the bucket's key
    buckets = buckets.select(F.shiftleft(F.xxhash64("l", "t", "c"), 12).bitwiseOR(F.col("t").cast("long")).alias("key"), "id")

    def compare(b: pa.RecordBatch, left: np.ndarray, right: np.ndarray):
        unit = [np.frombuffer(x, np.float64) for x in b.column(6).to_pylist()]
        x = np.stack(unit)
        s = x[left] @ x[right].T
        i, j = np.nonzero(s >= p.threshold)
        i, j = left[i], right[j]
        if np.array_equal(left, right):
            i, j = i[i < j], j[i < j]
        c = np.stack([np.frombuffer(r, np.int32) for r in b.column(7).to_pylist()])
        table = b.column(0)[0].as_py() & 4095
        first = np.argmax(c[i] == c[j], axis=1) if len(i) else i  # a pair counts in its first common table alone
        return i[first == table], j[first == table]

    found = stored(blocked_links(buckets, coded.select("id", "weight", "unit", "codes"), compare, p.block), "links")
    groups = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), "vectors")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    one = classes.select("id", "c1", "c2", "least", "weight").join(links, "id", "left").join(groups.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    one = stored(one.select("c1", "c2", "least", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n"), "component"), "class-links")
    names = stored(one.groupBy("component").agg(F.min("least").alias("name")), "component-names")
    one = stored(one.join(names, "component").select("c1", "c2", "n", "name"), "class-results")
    out = rows.select("k", "c1", "c2").join(one, ["c1", "c2"], "left")
    return out.select(
        F.col("k").alias(key), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("name", "k").alias("component_id"),
        F.coalesce(F.col("k") == F.coalesce("name", "k"), F.lit(False)).alias("kept"),
    )
