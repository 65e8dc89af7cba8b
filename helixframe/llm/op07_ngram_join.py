"""Operator 7: n-gram Jaccard join by MinHash banding, with exact verification on full n-gram sets.

A text's n-grams are its windows of n words (lower-cased; a text of fewer words has one, all its words). Texts with equal
n-gram sets are one class. A class's MinHash signature is cut into bands; the number of bands follows from the rows per
band and the wanted recall at the threshold. Classes that share a band are candidates: within a band's bucket, one byte
of each of the signature's minima and the set sizes rule out pairs that cannot reach the threshold (with a slack of
z standard deviations), and what is left is joined to candidate groups. Inside a candidate group every pair is then
verified on the full sets, in blocks, by one product of incidence matrices. Links come out as counts per class and a
root per unit, never as pairs, so output grows with the documents.

The full sets are made again from the texts for members of candidate groups alone; sets are not shuffled for others.

Defined results: a null text, or one without words, has no n-grams and links with nothing; texts of any length are
compared whole; copies are members of one class and each counts as a link; a null key comes back with null class;
repeated rows are documents of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .blocks import blocked_links, components
from .common import give_back, item_sizes, slices, stored, use_table
from .op02_toxicity import _HASHES, _WORD


@dataclass(frozen=True)
class Params:
    n: int = 5
    threshold: float = 0.8
    band_rows: int = 5
    recall: float = 0.9998
    z: float = 4.5
    block: int = 128
    bitmap_bits: int = 26
    seed: int = 7_001

    @property
    def bands(self) -> int:
        return math.ceil(math.log(1 - self.recall) / math.log(1 - self.threshold**self.band_rows))

    @property
    def least_equal(self) -> int:
        """Equal signature bytes that a pair at the threshold has but for z standard deviations."""
        k = self.bands * self.band_rows
        return math.floor(k * self.threshold - self.z * math.sqrt(k * self.threshold * (1 - self.threshold)))


def ngram_hashes(texts: list, n: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit n-gram hashes of each text."""
    use_table("words")
    words = [_WORD.findall(t.lower()) if t else [] for t in texts]
    count = np.array([len(w) for w in words], np.int64)
    h = np.fromiter(map(_HASHES.__getitem__, (w for x in words for w in x)), np.uint64, int(count.sum()))
    out, at = [], 0
    with np.errstate(over="ignore"):
        for c in count.tolist():
            own, at = h[at : at + c], at + c
            width = min(n, c)
            total = np.zeros(max(0, c - width + 1) if c else 0, np.uint64)
            for i in range(width):
                total = (total ^ own[i : i + len(total)]) * np.uint64(0x9E3779B97F4A7C15)
                total ^= total >> np.uint64(29)
            out.append(np.unique(total))
    return out


def signatures(sets: list[np.ndarray], p: Params) -> np.ndarray:
    """MinHash minima (texts x bands*rows) of non-empty sets."""
    rng = np.random.default_rng(p.seed)
    k = p.bands * p.band_rows
    flips, odds = rng.integers(0, 2**32, k, dtype=np.uint32), rng.integers(0, 2**31, k, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])))[:-1]
    out = np.empty((len(sets), k), np.uint32)
    with np.errstate(over="ignore"):
        for i in range(k):
            out[:, i] = np.minimum.reduceat((x ^ flips[i]) * odds[i], starts)
    return out


def band_keys(minima: np.ndarray, p: Params) -> np.ndarray:
    """64-bit key of each band (texts x bands)."""
    parts = minima.reshape(len(minima), p.bands, p.band_rows)
    key = np.broadcast_to(np.arange(1, p.bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for r in range(p.band_rows):
            key = (key ^ parts[:, :, r]) * np.uint64(0xFF51AFD7ED558CCD)
            key ^= key >> np.uint64(32)
    return key.view(np.int64)


def set_ids(sets: list[np.ndarray]) -> list[np.ndarray]:
    """Two 64-bit hashes of each whole set."""
    with np.errstate(over="ignore"):
        return [np.array([int((s * np.uint64(m) >> np.uint64(3)).sum(dtype=np.uint64) ^ np.uint64(len(s))) for s in sets], np.uint64).view(np.int64) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


SKETCH = "k long, th long, id long, id2 long, size int, sketch binary, bands array<long>"


def sketches(docs: DataFrame, p: Params) -> DataFrame:
    """Per row of docs (k, t), its class (two hashes of the whole set), set size, signature bytes and band keys; nulls and size 0 for a row without n-grams. th numbers the pair (k, t)."""
    schema = to_arrow_schema(StructType.fromDDL(SKETCH))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = None
            for a, z in slices(item_sizes(b.column(2)), 400_000):
                part = b.slice(a, z - a)
                sets = ngram_hashes(part.column(2).to_pylist(), p.n)
                full = np.array([len(s) > 0 for s in sets])
                none = part.filter(pa.array(~full))
                if none.num_rows:
                    yield pa.RecordBatch.from_arrays([none.column(0), none.column(1), *(pa.array([x] * none.num_rows, schema.field(i + 2).type) for i, x in enumerate((None, None, 0, None, None)))], schema=schema)
                if full.any():
                    sets, part = [s for s in sets if len(s)], part.filter(pa.array(full))
                    minima = signatures(sets, p)
                    bands = band_keys(minima, p)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, p.bands), pa.int32()), pa.array(bands.ravel()))
                    raw = (minima >> np.uint32(4)).astype(np.uint8)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), part.column(1), *map(pa.array, set_ids(sets)), pa.array([len(s) for s in sets], pa.int32()), pa.array([r.tobytes() for r in raw], pa.binary()), lists.cast(schema.field(6).type)],
                        schema=schema,
                    )
            del b, part
            give_back()

    return docs.select("k", F.xxhash64("k", "t").alias("th"), "t").mapInArrow(run, SKETCH)


def hash_bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """One bit per hash: 2**bits bits, whatever the number of hashes (column th). Built by all tasks; the driver gets at most 2**bits / 64 words."""
    at = F.pmod("th", F.lit(1 << bits))
    words = hashes.select(F.shiftright(at, 6).cast("int").alias("word"), (at % 64).cast("int").alias("bit")).groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits")).toPandas()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint64)


def _sets(docs: DataFrame, chosen: DataFrame, p: Params) -> DataFrame:
    """(id, id2, grams): the full n-gram sets of rows of docs (k, t) whose th is among the chosen, and of few others.

    The scan itself leaves out texts whose bit isn't set, so neither their texts nor their sets are shuffled; the exact
    choice is the caller's join on the set's two hashes. When very many have filled the bitmap it only saves less.
    """
    shared = docs.sparkSession.sparkContext.broadcast(hash_bitmap(chosen.select("th"), p.bitmap_bits))
    size = 1 << p.bitmap_bits

    def run(batches):
        bitmap = shared.value
        for b in batches:
            at = b.column(0).to_numpy() % size
            b = b.take(pa.array(np.flatnonzero((bitmap[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1))))
            for a, z in slices(item_sizes(b.column(1)), 400_000):
                sets = [s for s in ngram_hashes(b.column(1).slice(a, z - a).to_pylist(), p.n) if len(s)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, set_ids(sets)), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "id2", "grams"])
            del b
            give_back()

    return docs.select(F.xxhash64("k", "t").alias("th"), "t").mapInArrow(run, "id long, id2 long, grams binary")


def shared_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, step: int = 4096) -> np.ndarray:
    """Sizes of the intersections of sets left x right: products of 0/1 matrices over n-grams that occur more than once."""
    used = np.unique(np.concatenate((left, right)))
    flat = np.concatenate([sets[i] for i in used])
    of = np.repeat(np.arange(len(used)), [len(sets[i]) for i in used])
    grams, place, count = np.unique(flat, return_inverse=True, return_counts=True)
    keep = count[place] > 1
    renumber = np.cumsum(count > 1) - 1
    place, of = renumber[place[keep]], of[keep]
    order = np.argsort(place, kind="stable")
    place, of = place[order], of[order]
    rows = np.full(int(max(used)) + 1, -1)
    rows[used] = np.arange(len(used))
    out = np.zeros((len(left), len(right)), np.float32)
    width = int(place[-1]) + 1 if len(place) else 0
    for at in range(0, width, step):
        a, z = np.searchsorted(place, (at, at + step))
        m = np.zeros((len(used), min(step, width - at)), np.float32)
        m[of[a:z], place[a:z] - at] = 1
        out += m[rows[left]] @ m[rows[right]].T
    return out


def near_duplicates(docs: DataFrame, params: Params = Params(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, class_id (smallest key that links reach), copy_of (smallest key with the same n-gram set), n_links, kept: one row per row of docs."""
    p = params
    docs = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    made = stored(sketches(docs, p), "sketches")
    classes = stored(
        made.where("size > 0").groupBy("id", "id2").agg(
            F.min("k").alias("least"), F.min("th").alias("th"), F.count("*").alias("weight"), F.any_value("size").alias("size"), F.any_value("sketch").alias("sketch"), F.any_value("bands").alias("bands")
        ),
        "ngram-classes",
    )
    buckets = classes.select(F.explode("bands").alias("key"), "id")  # a band's number is part of its key
    least_equal, threshold = p.least_equal, p.threshold

    def likely(b: pa.RecordBatch, left: np.ndarray, right: np.ndarray):
        raw = b.column(6).to_pylist()
        s = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1)
        size = b.column(7).to_numpy().astype(np.float64)
        found_i, found_j = [], []
        own = np.array_equal(left, right)
        r, rs = s[right], size[right]
        for i in left.tolist():
            fits = (rs >= threshold * size[i]) & (rs * threshold <= size[i])
            if own:
                fits &= right > i
            at = np.flatnonzero(fits)
            at = at[(r[at] == s[i]).sum(axis=1) >= least_equal]
            found_i.append(np.full(len(at), i))
            found_j.append(right[at])
        return np.concatenate(found_i), np.concatenate(found_j)

    near = stored(blocked_links(buckets, classes.select("id", "weight", "sketch", "size"), likely, 2 * p.block).select("id", "root").distinct(), "candidates")
    groups = components(near.select(F.col("id").alias("a"), F.col("root").alias("b")), "candidate-groups")
    members = stored(groups.select(F.col("component").alias("key"), F.col("node").alias("id")).unionAll(groups.select(F.col("component").alias("key"), F.col("component").alias("id"))).distinct(), "members")
    # one text per class that has candidates
    chosen = stored(classes.select("id", "id2", "weight", "th").join(members.select("id"), "id"), "chosen")
    grams = _sets(docs, chosen, p).join(chosen.select("id", "id2", "weight"), ["id", "id2"])
    grams = stored(grams.select("id", "weight", "grams").dropDuplicates(["id"]), "ngram-sets")

    def verify(b: pa.RecordBatch, left: np.ndarray, right: np.ndarray):
        sets = [np.frombuffer(x, np.uint64) for x in b.column(6).to_pylist()]
        size = np.array([len(s) for s in sets], np.float64)
        shared = shared_counts(sets, left, right).astype(np.float64)
        either = size[left][:, None] + size[right][None, :] - shared
        i, j = np.nonzero(shared >= threshold * either - 1e-9)
        i, j = left[i], right[j]
        if np.array_equal(left, right):
            i, j = i[i < j], j[i < j]
        return i, j

    found = stored(blocked_links(members, grams, verify, p.block), "links")
    linked = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), "linked").withColumnRenamed("node", "id")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    one = classes.select("id", "id2", "least", "weight").join(links, "id", "left").join(linked, "id", "left").withColumn("component", F.coalesce("component", "id"))
    one = stored(one.select("id", "id2", "least", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n"), "component"), "class-links")
    names = stored(one.groupBy("component").agg(F.min("least").alias("name")), "class-names")
    one = stored(one.join(names, "component").select("id", "id2", "least", "n", "name"), "class-results")
    got = made.where("size > 0").select("k", "id", "id2").join(one, ["id", "id2"]).select("k", "least", "n", "name")
    # rows without n-grams stand for themselves
    out = got.unionByName(made.where("size = 0").select("k", F.col("k").alias("least"), F.lit(0).cast("long").alias("n"), F.col("k").alias("name")))
    return out.select(F.col("k").alias(key), F.col("name").alias("class_id"), F.col("least").alias("copy_of"), F.col("n").alias("n_links"), F.coalesce(F.col("k") == F.col("name"), F.lit(False)).alias("kept"))
