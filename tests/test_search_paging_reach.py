"""Maintained text index, bounded nearest vectors, keyset pages, rooted reachability; every query with SQL has rows."""

import os
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixframe import plans
from helixframe.operators import aggregates, graph, search

# ---- K8, T1 ------------------------------------------------------------------------------------------------------


def test_index_follows_upserts_and_deletes(spark, tmp_path):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(12)))
    index, state = search.TextIndex(spark, str(tmp_path / "index"), ranges=8), {}
    queries = spark.createDataFrame([(i, " ".join(rng.sample(words, 3)) + " unknown") for i in range(6)] + [(9, ""), (10, None)], "query long, text string")
    for batch in range(4):
        come = {rng.randrange(40): rng.choice([text(), text(), text(), None]) for _ in range(15)}
        go = [k for k in rng.sample(range(40), 6) if k not in come]
        frame = spark.createDataFrame(list(come.items()), "doc_id long, text string")
        gone = spark.createDataFrame([(k,) for k in go], "doc_id long")
        for _ in range(2 if batch == 2 else 1):  # sent again: nothing changes
            index.apply(batch, frame, gone)
        state = {k: t for k, t in state.items() if k not in go} | come
        live = spark.createDataFrame(list(state.items()), "doc_id long, text string")
        want = sorted(map(tuple, search.bm25(live, queries, "doc_id", "text", 5).collect()))
        assert sorted(map(tuple, index.bm25(queries, 5).collect())) == want and want
    # a batch whose driver was lost before its commit isn't seen, and is written over
    index.postings(["w1"]).count()
    frame = spark.createDataFrame([(1000, "w1 w1 w1")], "doc_id long, text string")
    frame.select(F.lit("w1").alias("term"), "doc_id", F.lit(3).alias("length"), F.lit(1).alias("sign"), F.lit(3).cast("long").alias("tf"), F.lit(0).alias("range")).write.partitionBy("range").parquet(str(tmp_path / "index/postings/batch=4"))
    assert index.postings(["w1"]).where("doc_id = 1000").count() == 0
    index.apply(4, frame)
    assert index.postings(["w1"]).where("doc_id = 1000").first().tf == 3
    read = index.postings(["w1"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in read and "range#" in read.split("PartitionFilters")[1].split("]")[0]


# ---- T5 ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("group", ["g", "id"])
def test_nearest_keeps_k_groups_a_task(spark, group):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 8)).round(1)  # ties
    rows = [(i, int(i % 37) if i % 50 else None, v.tolist()) for i, v in enumerate(x)] + [(900, 1, None), (901, 1, [1.0, None] + [0.0] * 6), (902, 1, [1.0] * 7)]
    df = spark.createDataFrame(rows, "id long, g long, v array<double>").repartition(5).cache()
    got = search.nearest(df, df.where("id % 50 = 0"), "id", "v", group, 3, block=7).collect()
    want = []
    for q, _, v in rows:
        if q % 50 == 0 and v is not None:
            best = {}
            for i, g, w in rows:
                if w is not None and len(w) == len(v) and None not in w and None not in v:
                    at = g if group == "g" else i
                    best[at] = max(best.get(at, -1e9), round(float(np.dot(w, v)), 6))
            ranked = sorted(best.items(), key=lambda e: (-e[1], e[0] is not None, e[0] or 0))[:3]
            want += [(q, g, s, r + 1) for r, (g, s) in enumerate(ranked)]
    assert sorted(((r.query, r[group], r.score, r["rank"]) for r in got), key=str) == sorted(want, key=str)


def test_what_nearest_shuffles_does_not_grow_with_vectors(spark):
    x = np.random.default_rng(5).normal(size=(4000, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(4).cache()
    best = search._Best(5)
    for a in range(0, 4000, 100):
        best.add((4, 0), np.arange(a, a + 100), x[a : a + 100] @ x[0])
    assert len(best.held[4, 0][0]) == 5 and set(best.held[4, 0][0].tolist()) == set(np.argsort(-(x @ x[0]))[:5].tolist())
    assert search.nearest(df, df.where("id < 3"), "id", "v", "id").count() == 15


def test_every_vector_is_a_query_of_t5_nearest(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = plans.QUERIES["t5_nearest"](spark, sf).groupBy("query").count().collect()
    assert {r.query for r in got} == {r.vec_id for r in v.collect()} and {r["count"] for r in got} == {5}
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    assert con.execute(f"select count(distinct query) from ({plans.SQL['t5_nearest']})").fetchone() == (v.count(),)


@pytest.mark.parametrize("block", [10, 4096])
@pytest.mark.parametrize("group", ["g", "id"])
def test_nearest_takes_all_rows_as_queries(spark, group, block):
    """In cells and by broadcast: repeated ids, rows and vectors, null groups beside long ids, other lengths, NaN, null vectors, ties."""
    rng = np.random.default_rng(8)
    far = 2**60
    rows = [(far + i // 2 if i < 20 else far + i, far + int(i % 23) if i % 9 else None, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 6)).round(1))]
    rows += [(7, 1, [0.5] * 6)] * 40 + [(8, 2, [0.5] * 6), (None, 3, [0.1] * 6), (None, None, [0.2] * 6), (9, 1, [1.0, 2.0]), (10, 4, [2.0, 2.0]), (11, 1, [3.0]), (12, 5, []), (13, 1, None), (14, 1, [1.0, None])]
    rows += [(15, 6, [float("nan")] * 3), (16, 6, [1.0, 2.0, 3.0]), (17, 7, [3.0, 2.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, g long, v array<double>").repartition(5).cache()
    best = {}
    for q, _, a in rows:
        for i, g, b in rows:
            if a is not None and b is not None and len(a) == len(b) and None not in a and None not in b:
                held, s = best.setdefault(q, {}), float(np.dot(a, b))
                at = g if group == "g" else i
                held[at] = max(held.get(at, -np.inf), np.inf if np.isnan(s) else round(s, 6))  # NaN is the largest
    want = []
    for q, held in best.items():
        ranked = sorted(held.items(), key=lambda e: (-e[1], e[0] is not None, e[0] or 0))[:3]
        want += [(q, g, s, r + 1) for r, (g, s) in enumerate(ranked)]
    got = search.nearest(df, df, "id", "v", group, 3, block=block).collect()
    got = [(r.query, r[group], np.inf if np.isnan(r.score) else r.score, r["rank"]) for r in got]
    near = lambda x: sorted(((q, g, round(s, 5) + 0.0, r) for q, g, s, r in x), key=str)
    assert near(got) == near(want)


def test_a_cell_keeps_what_it_keeps_at_once():
    rng = np.random.default_rng(9)
    asked = pa.table({"query": pa.array(range(50)), "q": pa.array(rng.normal(size=(50, 4)).tolist())})
    rows = pa.table({"g": pa.array((np.arange(400) % 31).tolist()), "v": pa.array(rng.normal(size=(400, 4)).tolist())})
    whole, parts = (search._cell(asked, rows, 4, n) for n in (1 << 22, 1500))  # 3 queries at once
    assert whole.num_rows == 200 and whole.sort_by([("query", "ascending"), ("g", "ascending")]).drop(["score"]) == parts.sort_by([("query", "ascending"), ("g", "ascending")]).drop(["score"])


# ---- L1, G14 -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("descending", [False, True])
def test_pages_by_cursor_are_the_list(spark, tmp_path, descending):
    rng = random.Random(6)
    rows = [(f"i{i:03d}", rng.choice([None, "a", "b", "b", "c", ""])) for i in range(95)]
    spark.createDataFrame(rows, "iri string, gene_label string").write.parquet(str(tmp_path / "list"))
    df = spark.read.parquet(str(tmp_path / "list"))
    whole = [tuple(r) for r in aggregates.page(df, 1000, 0, "GENE_LABEL", descending)[0].collect()]
    got, after = [], None
    while True:
        one = aggregates.page_after(df, 10, after, "GENE_LABEL", descending)
        after = aggregates.cursor(one)
        if after is None:
            break
        got += [tuple(r) for r in one.collect()]
    assert got == whole and len(got) == 95
    plan = aggregates.page_after(df, 10, ("b", "i010"), "GENE_LABEL", False)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(gene_label,b)" in plan  # the scan leaves earlier rows out


# ---- G7, G11 -----------------------------------------------------------------------------------------------------


def test_roots_reach_what_the_closure_has_and_write_no_more(spark, monkeypatch):
    rng = random.Random(7)
    edges = [(f"n{i}", f"n{rng.randrange(i + 1, 60)}") for i in range(55) for _ in range(2)] + [("n59", "n40"), ("n1", "n1"), (None, "n2"), ("n3", None)]  # with cycles
    e = spark.createDataFrame(edges, "child string, parent string")
    full = {(r.node, r.ancestor, r.depth) for r in graph.closure(e).collect()}
    asked = ["n50", "n10", "n59", "elsewhere"]
    roots = spark.createDataFrame([(x,) for x in [*asked, None, "n10"]], "root string")
    written = []
    real = graph._written
    monkeypatch.setattr(graph, "_written", lambda df, what: written.append(real(df, what)) or written[-1])
    got = {(r.root, r.node, r.depth) for r in graph.reachable(e, roots).collect()}
    assert got == {(a, a, 0) for a in asked} | {(n, x, d) for n, x, d in full if n in asked and n != x}
    assert sum(w.count() for w in written) <= 2 * len(got)  # rounds write each pair once, and a fold now and then
    down = {(r.root, r.node) for r in graph.reachable(e, roots, source="parent", target="child", reflexive=False).collect()}
    assert down == {(x, n) for n, x, _ in full if x in asked and n != x}


def test_instances_and_evidence_of_roots_equal_the_whole_trees(spark):
    classes = spark.createDataFrame([("dog", "animal"), ("cat", "animal"), ("animal", "thing"), ("animal", "animal")], "child string, parent string")
    types = spark.createDataFrame([("rex", "dog"), ("tom", "cat"), ("stone", "thing"), ("all", "animal")], "node string, type string")
    for cls in ("animal", "thing", "dog", "none"):
        want = {r.node for r in graph.instances_under(types, graph.closure(classes), cls).collect()}
        assert {r.node for r in graph.instances_of(types, classes, cls).collect()} == want
    edges = spark.createDataFrame([("r", "rex"), ("rex", "tom"), ("tom", "stone"), ("q", "tom")], "child string, parent string")
    roots, hide = spark.createDataFrame([("r",)], "root string"), spark.createDataFrame([("all",)], "evidence string")
    for cls in (None, "animal"):
        for transitive in (True, False):
            want = {r.evidence for r in graph.evidence_tree(edges, types, graph.closure(classes), cls, transitive, hide).where("node = 'r'").collect()}
            assert {r.evidence for r in graph.evidence_of(edges, roots, types, classes, cls, transitive, hide).collect()} == want


# ---- all queries -------------------------------------------------------------------------------------------------


def test_every_query_with_sql_has_rows():
    """An empty result proves nothing: on the tables of the correctness check no twin is without rows."""
    con, sf = duckdb.connect(), "/root/testdata/sf0.01"
    for f in os.listdir(sf):
        con.sql(f"create view {f[:-8]} as select * from '{sf}/{f}'")
    empty = [name for name, sql in plans.SQL.items() if not con.execute(f"select 1 from ({sql}) limit 1").fetchall()]
    assert empty == []
