"""Operators 11 to 13: brute force, oracles on hostile rows, bounds, ties, hot parts."""

import hashlib
import itertools
import math
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helixframe.llm import op11_license_scan as licenses
from helixframe.llm import op12_filter_audit as audit
from helixframe.llm import op13_centroids as centroids
from helixframe.llm import queries

DOCS = "doc_id long, text string, lang string, source string, n_words long, labels string, k long, found string, licenses string"


def docs(spark, rows):
    """(doc_id, text, source) with extra columns whose names clash with results."""
    return spark.createDataFrame([(i, t, None, s, 7, "x", 1, "y", "z") for i, t, s in rows], DOCS)


def cells(rows):
    return sorted(tuple("~" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


def same_as_sql(df, sql, **tables):
    con = duckdb.connect()
    for name, t in tables.items():
        arrow = pa.table(t.toArrow())
        con.register(name, arrow)
    got = con.sql(sql)
    order = sorted(got.columns)
    assert sorted(df.columns) == order
    theirs = [tuple(r[got.columns.index(c)] for c in order) for r in got.fetchall()]
    ours = [tuple(r[c] for c in order) for r in df.collect()]
    assert cells(ours) == cells(theirs)
    return ours


# ---- 11: license scan --------------------------------------------------------------------------------------------


def naive_scan(text):
    """All rules on the words, every pair of detections compared."""
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    padded = "".join(f" {w} " for w in words)
    found = []
    for n, r in enumerate(licenses.rules()):
        for m in re.finditer(r.regex, padded):
            start = padded[: m.start()].count(" ") // 2
            found.append((start, start + m[0].count(" ") // 2 - 1, r.tier, n, r.label))
    left = []
    for d in found:
        over = lambda e: e != d and e[0] <= d[0] and e[1] >= d[1] and (e[2] < d[2] or e[2] == d[2] and ((e[0], e[1]) != (d[0], d[1]) or e[3] < d[3]))
        if not any(over(e) for e in found):
            left.append(d)
    return words, [d for d in found if licenses.rules()[d[3]].base], sorted(left, key=lambda d: (d[0], -d[1], d[2], d[3]))


PHRASES = [
    "Licensed under the Apache License, Version 2.0.", "under the terms of the GNU General Public License version 3 or any later version", "cc by", "CC BY-NC 4.0", "MIT License", "mit", "All rights reserved.",
    "GPLv2", "the BSD 3-clause license", "all rights", "reserved", "general public", "license", "SPDX-License-Identifier: MPL-2.0", "Creative Commons Attribution-ShareAlike 4.0 International", "Copyright (c) 2019",
    "version 2.0 of the Apache License", "https://www.apache.org/licenses/LICENSE-2.0", "lesser general public license", "é straße", "released into the public domain", "12", "İ K", "\x00\x01\x02",
]


def test_license_scan_against_every_pair_of_detections(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(PHRASES) for _ in range(rng.randrange(12))) for _ in range(150)] + [None, "", " \n", "cc by " * 700]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in licenses.scan(df).select("doc_id", "licenses.*").collect():
        words, base, left = naive_scan(texts[r.doc_id])
        assert r.n_words == len(words)
        assert sorted((b.start, b.last, b.label) for b in r.base) == sorted((s, e, label) for s, e, _, _, label in base)
        assert [tuple(d) for d in r.detections] == left


def test_license_digest_equals_sql_on_hostile_rows(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(PHRASES) for _ in range(rng.randrange(10))), "s") for i in range(60)]
    rows += [(None, "cc by", None), (1, None, None), (1, "", ""), (1, "x " * 30_000 + "all rights reserved " * 5, "s"), (2, "cc by", "s"), (2, "cc by", "s")]
    d = docs(spark, rows)
    same_as_sql(licenses.digest(d), licenses.oracle(), documents=d.select("doc_id", "text"))
    out = licenses.scan(d)
    assert out.columns == d.columns and out.where("licenses.n_words is null").count() == 0
    assert licenses.digest(docs(spark, [])).count() == 0


def test_license_scan_is_native_and_names_what_it_finds(spark):
    df = licenses.digest(spark.createDataFrame([(1, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"), (2, "Diese Woche kam er mit Lizenz im Zug"), (3, "GNU Lesser General Public License, version 2.1 or later")], "doc_id long, text string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)
    assert {r.doc_id: r.labels for r in df.collect()} == {1: "mit", 2: "", 3: "gpl,lgpl-2.1-or-later"}
    assert len(licenses.rules()) > 300


def example(tree, rng):
    """A string that a parsed pattern matches, its choices drawn at random."""
    out = ""
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name == "NOT_LITERAL":
            out += "z"
        elif name == "IN":
            first = arg[0]
            out += "z" if str(first[0]) == "NEGATE" else chr(first[1] if str(first[0]) == "LITERAL" else first[1][0])
        elif name == "BRANCH":
            out += example(rng.choice(arg[1]), rng)
        elif name == "SUBPATTERN":
            out += example(arg[3], rng)
        else:
            low, high, inner = arg
            out += "".join(example(inner, rng) for _ in range(rng.randint(low, min(int(high), low + 3))))
    return out


def test_every_rule_holds_its_keywords():
    """The gate hides no match: whatever a pattern matches has the keywords among its words."""
    rng = random.Random(1)
    for r in licenses.rules():
        tree = re._parser.parse(r.regex)
        for _ in range(12):
            text = example(tree, rng)
            assert re.fullmatch(r.regex, text), (text, r.regex)
            assert set(r.keywords) <= set(text.split()), (text, r.keywords)


# ---- 12: filter audit --------------------------------------------------------------------------------------------

SORTED = st.lists(st.integers(0, 300), max_size=80, unique=True).map(lambda x: np.array(sorted(x), np.int32))


@settings(max_examples=150, deadline=None)
@given(st.lists(SORTED, min_size=1, max_size=5), st.integers(1, 9))
def test_galloping_is_set_algebra(lists, step):
    sets = [set(x.tolist()) for x in lists]
    assert audit.union(lists).tolist() == sorted(set().union(*sets))
    a, b = lists[0], lists[-1]
    assert audit.difference(a, b).tolist() == sorted(sets[0] - sets[-1])
    assert audit.common(a, b).tolist() == sorted(sets[0] & sets[-1])
    assert audit.leap(a, b, step).tolist() == np.searchsorted(a, b).tolist()


def naive_audit(rows, labels):
    """Every order walked row by row."""
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, x in labels if i is not None and x == 1}

    def fails(i, t):
        t = t or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        checks = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and first[t] < i}
        return {k for k, v in checks.items() if v}

    held = [(s or "", i, fails(i, t)) for i, t, s in rows]
    out = {}
    for part in {p for p, _, _ in held}:
        mine = [(i, f) for p, i, f in held if p == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shapley[f] += len(gone)
                out[part, "".join(order), k + 1] = [len(left), len(gone), sum(f in x[1] for x in mine) - len(gone), sum(x[1] == {f} for x in mine), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), f]
        for key, v in out.items():
            if key[0] == part:
                v[-1] = shapley[v[-1]]
    return {k: tuple(v) for k, v in out.items()}


def audit_rows():
    rng = random.Random(6)
    texts = [None, "", "A B c", "x# " * 250, "LOUD " * 210, " ".join(f"w{i}" for i in range(220)), " ".join(f"w{i} $" for i in range(220)), "a\x0bb\x1cc d", "same " * 201]
    rows = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice([None, "", "hot", "hot", "hot", "s1"])) for _ in range(160)]
    labels = [(rng.choice([None, *range(40)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(40)]
    return rows, labels


def test_filter_audit_against_walking_every_order(spark):
    rows, labels = audit_rows()
    d, marks = docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = naive_audit(rows, labels)
    got = audit.audit(d, marks).collect()
    assert {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got} == want
    assert len(got) == len(want) == 600 * len({s or "" for _, _, s in rows})
    same_as_sql(audit.audit(d, marks), audit.oracle(), documents=d.select("doc_id", "text", "source"), labels=marks)
    assert audit.audit(docs(spark, []), marks).count() == 0


def test_posting_lists_split_a_hot_part_and_a_hot_key(spark):
    """3,000 rows of one part, 2,000 of them with a null key: several blocks in several tasks, and the sizes still add up."""
    rows = spark.range(3000).select(F.lit("hot").alias("part"), F.when(F.col("id") < 1000, F.col("id")).alias("key"), (F.col("id") % 2 == 0).alias("A"), (F.col("id") % 3 == 0).alias("B"), (F.col("id") % 5 == 0).alias("m")).repartition(7)
    lists = audit.posting_lists(rows, "part", "key", ["A", "B"], ["m"], block=100)
    held = lists.withColumn("p", F.spark_partition_id()).collect()
    assert max(r.n_rows for r in held) <= 100 and sum(r.n_rows for r in held) == 3000 and len({r.block for r in held}) == len(held) >= 30
    assert len({r.p for r in held}) >= 3
    assert all(list(r.A) == sorted(set(r.A)) and all(0 <= x < r.n_rows for x in r.A) for r in held)
    got = {(r.filter, r.earlier): (r.fails, r.gone, r.new, r.new_m) for r in audit.set_sizes(lists, ["A", "B"], ["m"]).collect()}
    assert got == {("A", 0): (1500, 0, 1500, 300), ("B", 0): (1000, 0, 1000, 200), ("A", 2): (1500, 1000, 1000, 200), ("B", 1): (1000, 1500, 500, 100)}


# ---- 13: centroids -----------------------------------------------------------------------------------------------


def naive_clusters(rows, k=40, rounds=5, dims=64):
    """Plain Python integers."""
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    seed = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    c = [list(v) for _, v in sorted(kept, key=seed)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), j) for j, w in enumerate(c))
    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(near(v)[1], []).append(v)
        c = [[sum(x) // len(own[j]) for x in zip(*own[j], strict=True)] if j in own else c[j] for j in range(len(c))]
    told = [(i, *near(v)) for i, v in kept]
    inertia = {}
    for _, d, j in told:
        inertia[j] = inertia.get(j, 0) + d
    return sorted(((str(i), j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in told))


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], f"vec_id long, embedding array<{kind}>, cluster int, distance long")


def test_centroids_against_plain_integers_on_hostile_vectors(spark):
    rng = np.random.default_rng(8)
    v = [rng.normal(size=64).round(2).tolist() for _ in range(150)]
    rows = list(enumerate(v)) + [(3, v[3]), (7, v[8]), (None, v[0]), (200, None), (201, v[1][:63]), (202, [*v[1][:63], None]), (203, [*v[1][:63], float("nan")]), (204, [*v[1][:63], float("inf")]), (205, [0.0] * 64), (206, [0.0] * 64), (207, [])]
    rows += [(300 + i, v[5]) for i in range(90)]  # a third of all rows are one vector
    got = centroids.cluster(vectors(spark, rows, "double"))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == naive_clusters(rows)
    assert centroids.cluster(vectors(spark, [])).count() == 0 and centroids.cluster(vectors(spark, [(1, None)])).count() == 0


def test_centroids_ties_few_vectors_and_far_ones(spark):
    near = [(i, [float(i // 2), *[0.0] * 63]) for i in range(12)]  # fewer than k; equal vectors make empty centroids and ties
    assert sorted((str(r[0]), *r[1:]) for r in centroids.cluster(vectors(spark, near)).collect()) == naive_clusters(near)
    far = [(i, [2.0 ** (i % 30), *[float(i)] * 63]) for i in range(60)]
    assert sorted((str(r[0]), *r[1:]) for r in centroids.cluster(vectors(spark, far)).collect()) == naive_clusters(far)
    beyond = centroids.cluster(vectors(spark, [(1, [1e30] * 64), (2, [-1e30] * 64)]), centroids.Params(k=1))
    assert {r.distance for r in beyond.collect()} <= {0, (1 << 63) - 1} | {r.distance for r in beyond.collect() if r.distance > 1 << 62}


def test_bounds_skip_most_centroids_and_lose_none():
    """Clustered vectors: far fewer pairs are measured than there are, and the nearest is always among them."""
    rng = np.random.default_rng(9)
    heart = rng.normal(size=(30, 64)) * 300
    x = np.floor(heart[rng.integers(30, size=3000)] + rng.normal(size=(3000, 64)) * 20).astype(np.int64)
    c = np.floor(heart).astype(np.int64)
    mean = x.mean(axis=0)
    rotation = centroids.Rotation(mean, np.linalg.eigh(np.cov(x.T))[1][:, ::-1], 16)
    which, d, measured = centroids.nearest(x, *rotation.of(x), centroids.Centroids.at(c, rotation), pairs=100)
    every = ((x[:, None, :] - c) ** 2).sum(axis=2)
    assert np.array_equal(which, every.argmin(axis=1)) and np.array_equal(d, every.min(axis=1))
    assert measured < 3000 * 3


@pytest.mark.parametrize("name", ["op11_license_scan", "op12_filter_audit", "op13_centroids"])
def test_registered_with_sql(name):
    assert name in queries.QUERIES and name in queries.SQL
