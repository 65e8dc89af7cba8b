"""Operator 2: toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes (2**bits slots) of its words, word pairs and pairs with one word between, all
lower-cased. FTRL-proximal is a sequential method (averaging separately trained shards lost a third of the held-out
recall here), so it learns from a sample whose rows and features max_rows and max_slots bound: features are made by all
tasks, from whole texts, and one task makes the passes (a learning rate per coordinate; L1 makes most weights exactly zero; features in fewer
than min_rows rows are left out). The result is an intercept and a sparse vector of at most 2**bits weights, in
practice some hundreds, small enough to send to every task. Scoring reads each whole text once, without a shuffle.

Defined results: a null or empty text, or one without words, scores the intercept alone; texts of any length are scored
whole; repeated rows score alike; several labels of one document count as toxic if any is; null labels and null keys are
not learnt from; with no labelled row every text scores 0 from an intercept of minus infinity; an empty table gives
an empty result; other columns pass through, except those that bear a result column's name, which are replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, keep_table, stored, use_table, with_text_columns

_WORD = re.compile(r"[^\W_]+")
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


@dataclass(frozen=True)
class Params:
    """max_rows and max_slots bound the labelled sample (chosen by a hash of key and text): about so many rows, and features in all; the rest is fixed, whatever the input's size."""

    bits: int = 20
    max_rows: int = 16_000
    max_slots: int = 32_000_000
    min_rows: int = 4
    epochs: int = 6
    alpha: float = 3.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 0.0


@dataclass(frozen=True)
class Model:
    bits: int
    intercept: float
    slots: np.ndarray  # sorted feature slots with a weight
    weights: np.ndarray


class WordHashes(dict):
    """Word -> 64-bit hash; emptied when large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = WordHashes()
keep_table("words", _HASHES.clear)


def features(texts: list, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature slots of all texts, and each slot's text number; a slot may repeat within a text."""
    use_table("words")
    words = [_WORD.findall(t.lower()) if t else [] for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    h = np.fromiter(map(_HASHES.__getitem__, (w for x in words for w in x)), np.uint64, int(n.sum()))
    of = np.repeat(np.arange(len(texts)), n)
    shift = np.uint64(64 - bits)
    with np.errstate(over="ignore"):
        parts, owners = [(h * _A) >> shift], [of]
        for gap, salt in ((1, _B), (2, _C)):
            pair = ((h[:-gap] * _B) ^ (h[gap:] * salt + _A)) * _A >> shift
            same = of[:-gap] == of[gap:]
            parts.append(pair[same])
            owners.append(of[:-gap][same])
    return np.concatenate(parts).astype(np.int64), np.concatenate(owners)


def distinct_features(texts: list, bits: int) -> list[np.ndarray]:
    slots, of = features(texts, bits)
    both = np.unique(of << bits | slots)
    cuts = np.searchsorted(both, np.arange(len(texts) + 1) << bits)
    return [both[a:z] & ((1 << bits) - 1) for a, z in zip(cuts, cuts[1:], strict=False)]


def ftrl(rows: list[np.ndarray], labels: np.ndarray, p: Params) -> tuple[float, np.ndarray]:
    """FTRL-proximal passes over rows (arrays of distinct slots): the intercept and all weights."""
    z, n = np.zeros(1 << p.bits), np.zeros(1 << p.bits)
    z0 = n0 = 0.0

    def weights(zi, ni):
        return np.where(np.abs(zi) <= p.l1, 0.0, (np.sign(zi) * p.l1 - zi) / ((p.beta + np.sqrt(ni)) / p.alpha + p.l2))

    for _ in range(p.epochs):
        for x, y in zip(rows, labels, strict=True):
            zi, ni = z[x], n[x]
            w = weights(zi, ni)
            w0 = -z0 / ((p.beta + math.sqrt(n0)) / p.alpha)
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, w0 + w.sum())))) - y
            root = np.sqrt(ni + g * g)
            z[x] = zi + g - (root - np.sqrt(ni)) / p.alpha * w
            n[x] = ni + g * g
            z0 += g - (math.sqrt(n0 + g * g) - math.sqrt(n0)) / p.alpha * w0
            n0 += g * g
    return -z0 / ((p.beta + math.sqrt(n0)) / p.alpha), weights(z, n)


def fit(docs: DataFrame, labels: DataFrame, params: Params = Params(), key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Learns from the rows of labels (key, label 0/1) and the texts of docs with the same key.

    A key's different texts are learnt one by one, a text that it repeats once. If there are more labelled rows than
    max_rows, about max_rows of their (key, text) pairs are taken, by a hash of both; of those, if their texts have more
    than max_slots features, about as many as have max_slots.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(F.col(label).cast("int")).alias("_y"))
    p = params
    count = known.count()
    if count > 4 * p.max_rows:  # more keys than may be sent to every task: fewer by their hash first
        known = known.where(F.pmod(F.xxhash64("_key"), F.lit(1 << 30)) < int(4 * p.max_rows / count * (1 << 30)))
    # at most about 4 * max_rows rows of two numbers: a proven bound
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(known), "_key")
    rows = rows.withColumn("_hash", F.xxhash64("_text"))
    n, keys = rows.agg(F.count("*"), F.count_distinct("_key")).first()
    repeated = n > keys
    if repeated:  # of a key's rows each different text counts
        n = rows.select("_key", "_hash").distinct().count()
    if n > p.max_rows:
        rows = rows.where(F.pmod(F.xxhash64("_key", "_hash"), F.lit(1 << 30)) < int(p.max_rows / n * (1 << 30)))
    if repeated:  # equal rows are one, taken together per task before they are shuffled
        rows = rows.groupBy("_key", "_hash").agg(F.any_value("_y").alias("_y"), F.any_value("_text").alias("_text"))

    def make():
        return lambda texts: [[x.astype(np.int32) for x in distinct_features([t or "" for t in texts], p.bits)]]

    ready = with_text_columns(rows, "_text", make, [T.StructField("_slots", T.ArrayType(T.IntegerType()))]).drop("_text")
    ready = stored(ready, "toxicity-features")
    slots = ready.agg(F.sum(F.size("_slots"))).first()[0] or 0
    if slots > p.max_slots:
        ready = ready.where(F.pmod(F.xxhash64("_key", "_hash", F.lit(2)), F.lit(1 << 30)) < int(p.max_slots / slots * (1 << 30)))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, hashes, labels, parts = [], [], [], []
        count = np.zeros(1 << p.bits, np.int64)
        for b in batches:
            lists = b.column(3)
            flat = np.array(lists.flatten().to_numpy(zero_copy_only=False), np.int32)
            count += np.bincount(flat, minlength=len(count))  # a row's slots are distinct
            keys += [xxhash.xxh3_64_intdigest(str(k)) for k in b.column(0).to_pylist()]
            hashes.append(b.column(1).to_numpy())
            labels.append(b.column(2).to_numpy())
            parts.append((flat, np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))))))
            del b, lists
        if not keys:
            return
        common = count >= min(p.min_rows, len(keys))
        del count
        rows = []
        for i, (flat, ends) in enumerate(parts):
            parts[i] = None  # one batch's numbers go as its rows are made smaller
            rows += [x[common[x]] for x in (flat[a:z] for a, z in zip(ends, ends[1:], strict=False))]
            del flat
        order = np.lexsort((np.concatenate(hashes), np.array(keys, np.uint64)))
        w0, w = ftrl([rows[i] for i in order], np.concatenate(labels).astype(float)[order], p)
        found = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(found, -1), pa.int64()), pa.array(np.append(w[found], w0))], ["slot", "w"])
        give_back()

    # one task, of at most about max_rows rows and max_slots numbers, taken batch by batch from the files
    got = ready.select("_key", "_hash", "_y", "_slots").coalesce(1).mapInArrow(learn, "slot long, w double").toPandas()  # at most 2**bits + 1 rows
    if got.empty:
        return Model(p.bits, -math.inf, np.zeros(0, np.int64), np.zeros(0))
    w0 = float(got.loc[got["slot"] == -1, "w"].iloc[0])
    got = got[got["slot"] >= 0].sort_values("slot")
    return Model(p.bits, w0, got["slot"].to_numpy(np.int64), got["w"].to_numpy(float))


def score_texts(model: Model, texts: list, dense: np.ndarray) -> np.ndarray:
    slots, of = features(texts, model.bits)
    w = dense[slots]
    has = np.flatnonzero(w)
    both = np.unique(of[has] << model.bits | slots[has])
    total = np.bincount(both >> model.bits, weights=dense[both & ((1 << model.bits) - 1)], minlength=len(texts))
    if model.intercept == -math.inf:
        return np.zeros(len(texts))
    return 1 / (1 + np.exp(-np.clip(model.intercept + total, -700, 700)))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score", flag: str = "predicted", threshold: float = 0.5) -> DataFrame:
    """docs with a score from 0 to 1 and the decision (1 at the threshold or above)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        dense = np.zeros(1 << m.bits, np.float32)
        dense[m.slots] = m.weights

        def run(texts):
            s = score_texts(m, texts, dense)
            return [s.tolist(), (s >= threshold).astype(int).tolist()]

        return run

    return with_text_columns(docs, text, make, [T.StructField(out, T.DoubleType()), T.StructField(flag, T.IntegerType())])
