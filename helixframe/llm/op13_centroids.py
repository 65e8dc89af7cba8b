"""Operator 13: centroid clustering in integers, filtered by bounds in PCA-rotated coordinates.

Kept vectors become integers, floor(scale * x). Their means and products are summed by all tasks; the eigenvectors of the
covariance (dims x dims, on the driver) give a rotation. Stored with every vector are its leading rotated coordinates and
the norm of the rest. For a vector x and a centroid c,

    |x - c|^2  >=  |lead(x) - lead(c)|^2 + (rest(x) - rest(c))^2,

so the right side, cheap and of few coordinates, bounds every centroid from below. The centroid of the smallest bound is
measured exactly; those whose bound (less a slack that covers rounding) isn't above that distance survive, and survivors
are measured in integers. Results are exact: the rotation decides only how much is skipped.

A round is one pass over the stored vectors: tasks add up exact integer sums per centroid, k x dims numbers each, Spark adds
these, and the driver floors them. What reaches the driver and the tasks' closures is k x dims and dims x dims numbers,
whatever the input; no vector is shuffled, so hot clusters and repeated vectors don't matter.

Defined results: vectors that are null, of another length, or hold null or non-finite components (after scaling, too) are
not kept and have no row. Scaled components beyond 2^62 count as 2^62, distances beyond a long as the greatest long.
Repeated rows and equal ids are vectors of their own; a null id has no hash and comes last as a seed; seeds of equal
hashes go by their components. Of fewer than k vectors each is a seed. An empty table gives an empty result. Columns that
aren't named are not read.
"""

from __future__ import annotations

import decimal
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, stored

_GREATEST = (1 << 63) - 1
_EXACT = 1 << 28  # differences below it have squares whose sum over 64 components is below 2^62


@dataclass(frozen=True)
class Params:
    k: int = 40
    rounds: int = 5
    dims: int = 64
    scale: int = 256
    leading: int = 16
    seed: str = "2:"


def to_integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as int64."""
    return np.clip(np.floor(scale * x.astype(np.float64)), -(2.0**62), 2.0**62).astype(np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of paired rows; beyond a long as Python integers."""
    if not len(x) or int(np.abs(x).max()) + int(np.abs(c).max()) < _EXACT * 8 // x.shape[1] ** 0.5:
        d = x - c
        return np.einsum("ij,ij->i", d, d)
    d = x.astype(object) - c.astype(object)
    return (d * d).sum(axis=1)


@dataclass(frozen=True)
class Rotation:
    mean: np.ndarray
    axes: np.ndarray  # columns, leading first
    leading: int

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Leading coordinates, norm of the rest, and a length that bounds what rounding can do."""
        y = x.astype(np.float64)
        z = (y - self.mean) @ self.axes
        rest = np.sqrt((z[:, self.leading :] ** 2).sum(axis=1))
        return np.ascontiguousarray(z[:, : self.leading]), rest, np.sqrt((y * y).sum(axis=1)) + np.sqrt((self.mean**2).sum())


@dataclass(frozen=True)
class Centroids:
    """Integer centroids with their rotated form."""

    ints: np.ndarray
    lead: np.ndarray
    rest: np.ndarray
    length: np.ndarray

    @classmethod
    def at(cls, ints: np.ndarray, rotation: Rotation) -> Centroids:
        return cls(ints, *rotation.of(ints))


def nearest(x: np.ndarray, lead: np.ndarray, rest: np.ndarray, length: np.ndarray, c: Centroids, pairs: int = 16_384) -> tuple[np.ndarray, np.ndarray, int]:
    """For each vector the nearest centroid (of equal ones the smaller number), its squared distance, and how many pairs were measured."""
    low = (lead * lead).sum(axis=1)[:, None] + (c.lead * c.lead).sum(axis=1) - 2 * (lead @ c.lead.T) + (rest[:, None] - c.rest) ** 2
    guess = low.argmin(axis=1)
    best = squared(x, c.ints[guess])
    slack = 1e-9 * (length[:, None] + c.length) ** 2 + 1
    i, j = np.nonzero(low - slack <= best.astype(np.float64)[:, None])  # row by row, so every vector's survivors stand together
    measured = [squared(x[i[a : a + pairs]], c.ints[j[a : a + pairs]]) for a in range(0, len(i), pairs)]
    d = np.concatenate(measured) if measured else np.empty(0, np.int64)
    starts = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1]))) if len(i) else i
    least = np.minimum.reduceat(d, starts) if len(i) else d
    sizes = np.diff(np.concatenate((starts, [len(i)])))
    hits = np.flatnonzero(d == np.repeat(least, sizes))
    first = hits[np.concatenate(([True], i[hits][1:] != i[hits][:-1]))] if len(hits) else hits
    return j[first], least, len(i)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Stored integers: four bytes a component where they suffice, else eight."""
    raw = column.to_pylist()
    if all(len(r) == 4 * dims for r in raw):
        return np.frombuffer(b"".join(raw), "<i4").reshape(-1, dims).astype(np.int64)
    return np.stack([np.frombuffer(r, "<i4" if len(r) == 4 * dims else "<i8").astype(np.int64) for r in raw])


def _packed(x: np.ndarray) -> list[bytes]:
    small = (np.abs(x) < 1 << 31).all(axis=1)
    return [r.astype("<i4" if s else "<i8").tobytes() for r, s in zip(x, small.tolist(), strict=True)]


def cluster(vectors: DataFrame, params: Params = Params(), key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia, centroid_sha256: one row per kept vector."""
    p, spark = params, vectors.sparkSession
    kind = vectors.schema[key].dataType
    v = F.col("v")
    scaled = lambda e: F.abs(e * F.lit(float(p.scale)))
    good = (F.size("v") == p.dims) & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (scaled(e) < float("inf")))
    kept = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).where(v.isNotNull()).where(good)
    seeds = T.StructType([T.StructField("id", kind), T.StructField("hash", T.StringType()), T.StructField("ints", T.BinaryType()), T.StructField("order", T.ArrayType(T.LongType()))])

    def integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = to_integers(b.column(2).flatten().to_numpy().reshape(-1, p.dims), p.scale)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(_packed(x), pa.binary()), pa.array(list(x), pa.list_(pa.int64()))], ["id", "hash", "ints", "order"])

    hashed = kept.select("id", F.sha2(F.concat(F.lit(p.seed), F.col("id").cast("string")), 256).alias("hash"), "v")
    first = hashed.mapInArrow(integers, seeds).orderBy(F.col("hash").asc_nulls_last(), "order").select("order").limit(p.k).collect()
    out = T.StructType([T.StructField(key, kind), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    more = [T.StructField("cluster_inertia", T.LongType()), T.StructField("inertia", T.LongType()), T.StructField("centroid_sha256", T.StringType())]
    if not first:
        return spark.createDataFrame([], T.StructType(out.fields + more))
    ints = np.array([r[0] for r in first], np.int64)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, square = 0, np.zeros(p.dims), np.zeros((p.dims, p.dims))
        for b in batches:
            x = to_integers(b.column(0).flatten().to_numpy().reshape(-1, p.dims), p.scale).astype(np.float64)
            n, total, square = n + len(x), total + x.sum(axis=0), square + x.T @ x
        flat = np.concatenate(([n], total, square.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int64()), pa.array(flat.astype(np.float64))], ["at", "value"])

    sums = kept.select("v").mapInArrow(products, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()  # 1 + dims + dims^2 numbers
    flat = np.zeros(1 + p.dims + p.dims**2)
    for at, value in sums:
        flat[at] = value
    n = max(flat[0], 1)
    mean = flat[1 : 1 + p.dims] / n
    spread = flat[1 + p.dims :].reshape(p.dims, p.dims) / n - np.outer(mean, mean)
    rotation = Rotation(mean, np.ascontiguousarray(np.linalg.eigh((spread + spread.T) / 2)[1][:, ::-1]), min(p.leading, p.dims))

    def rotated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = to_integers(b.column(1).flatten().to_numpy().reshape(-1, p.dims), p.scale)
            lead, rest, length = rotation.of(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_packed(x), pa.binary()), pa.array([r.tobytes() for r in lead], pa.binary()), pa.array(rest), pa.array(length)], ["id", "ints", "lead", "rest", "length"])
        give_back()

    form = T.StructType([T.StructField("id", kind), T.StructField("ints", T.BinaryType()), T.StructField("lead", T.BinaryType()), T.StructField("rest", T.DoubleType()), T.StructField("length", T.DoubleType())])
    rows = stored(kept.mapInArrow(rotated, form), "rotated")

    def parts(b: pa.RecordBatch, at: int, c: Centroids):
        x = _matrix(b.column(at), p.dims)
        lead = np.frombuffer(b"".join(b.column(at + 1).to_pylist()), np.float64).reshape(len(x), -1)
        return x, nearest(x, lead, b.column(at + 2).to_numpy(), b.column(at + 3).to_numpy(), c)

    def moved(c: Centroids):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((len(c.ints), p.dims + 1), object)  # Python's integers: exact at any size
            for b in batches:
                if b.num_rows:
                    x, (which, _, _) = parts(b, 0, c)
                    narrow = int(np.abs(x).max()) < 1 << 40
                    for j in np.unique(which).tolist():
                        own = x[which == j]
                        sums[j, :-1] += (own if narrow else own.astype(object)).sum(axis=0).astype(object)
                        sums[j, -1] += len(own)
            j, at = np.nonzero(sums != 0)
            values = pa.array([decimal.Decimal(int(s)) for s in sums[j, at]], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(j, pa.int32()), pa.array(at, pa.int32()), values], ["cluster", "at", "value"])
            give_back()

        return run

    for _ in range(p.rounds):
        told = rows.select("ints", "lead", "rest", "length").mapInArrow(moved(Centroids.at(ints, rotation)), "cluster int, at int, value decimal(38,0)")
        sums = np.zeros((len(ints), p.dims + 1), object)
        for j, at, value in told.groupBy("cluster", "at").agg(F.sum("value").alias("value")).collect():  # k x (dims + 1) numbers at most
            sums[j, at] = int(value)
        ints = np.array([[int(s) // int(row[-1]) for s in row[:-1]] if row[-1] else old.tolist() for row, old in zip(sums, ints, strict=True)], np.int64)
    last = Centroids.at(ints, rotation)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                _, (which, d, _) = parts(b, 1, last)
                longs = pa.array([min(int(x), _GREATEST) for x in d], pa.int64()) if d.dtype == object else pa.array(d)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(which, pa.int32()), longs], [key, "cluster", "distance"])
        give_back()

    found = stored(rows.mapInArrow(assigned, out), "assigned")
    inertia = {r[0]: int(r[1]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}  # k rows at most
    whole = min(sum(inertia.values()), _GREATEST)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in ints.tolist()]
    told = [(j, min(n, _GREATEST), whole, digests[j]) for j, n in inertia.items()]
    if not told:
        return spark.createDataFrame([], T.StructType(out.fields + more))
    return found.join(F.broadcast(spark.createDataFrame(told, T.StructType([out.fields[1], *more]))), "cluster").select(*out.names, *[f.name for f in more])


def oracle(p: Params = Params(), table: str = "embeddings", key: str = "vec_id", vector: str = "embedding") -> str:
    """DuckDB SQL for cluster(): every vector against every centroid, round by round."""
    distance = "list_sum(list_transform(list_zip(v.x, c.x), lambda e: (e[1] - e[2]) * (e[1] - e[2])))"
    wide = 1 << 10  # above k: distance and number in one integer, the smaller number first

    def assign(i: int) -> str:
        return f"a{i} AS MATERIALIZED (SELECT v.r, any_value(v.x) AS x, min(CAST({distance} AS HUGEINT) * {wide} + c.c) AS m FROM v, c{i} c GROUP BY v.r)"

    def move(i: int) -> str:
        return f"""u{i} AS (SELECT m % {wide} AS c, unnest(x) AS e, unnest(range(0, {p.dims})) AS pos FROM a{i}
), s{i} AS (SELECT c, pos, CAST(sum(e) AS HUGEINT) AS s, count(*) AS n FROM u{i} GROUP BY c, pos
), f{i} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY pos) AS x FROM s{i} GROUP BY c
), c{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(f.x, o.x) AS x FROM c{i} o LEFT JOIN f{i} f ON o.c = f.c)"""

    steps = ",\n".join(f"{assign(i)},\n{move(i)}" for i in range(p.rounds))
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, {key} AS k, list_transform({vector}, lambda e: CAST(floor({p.scale} * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM {table}
  WHERE {vector} IS NOT NULL AND len({vector}) = {p.dims} AND len(list_filter({vector}, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{p.seed}' || k) NULLS LAST, x) - 1 AS c, x FROM v ORDER BY c LIMIT {p.k}
), {steps},
{assign(p.rounds)}, d AS (SELECT v.k, m % {wide} AS c, m // {wide} AS distance FROM a{p.rounds} a JOIN v ON a.r = v.r)
SELECT d.k AS {key}, CAST(d.c AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY d.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM d JOIN c{p.rounds} c ON d.c = c.c
"""
