"""Operators against brute force and worked examples."""

import collections
import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helixframe.operators import builders, conflicts, filters, graph, intervals, patterns, scores, search

LOC = "seq_ref string, start_outer long, start_inner long, end_inner long, end_outer long, is_range boolean"


def kind(v, f):
    """The documented rules, by hand."""
    (_, _, vs, ve, *_), (_, _, fs, fe, *_) = v[1:], f[1:]
    a_o, a_s, a_e, a_x, ar = v[1:]
    b_o, b_s, b_e, b_x, br = f[1:]
    if None in (a_s, a_e, b_s, b_e):
        return "NoOverlap"
    if a_s < b_s and b_e < a_e:
        return "CompleteOverlap"
    if (a_s < b_s < a_e) or (b_e < a_e and b_s < b_e):
        return "PartialOverlap"
    if (ar or br) and None not in (a_o, a_x, b_o, b_x) and not (a_x < b_o or b_x < a_o):
        return "OuterOverlap"
    return "NoOverlap"


def test_overlap_kind_examples(spark):
    rows = [
        (("s", 1, 1, 10, 10, False), ("s", 2, 2, 5, 5, False), "CompleteOverlap"),
        (("s", 1, 1, 10, 10, False), ("s", 1, 1, 10, 10, False), "NoOverlap"),
        (("s", 3, 3, 5, 5, False), ("s", 1, 1, 10, 10, False), "NoOverlap"),
        (("s", 1, 1, 10, 10, False), ("s", 5, 5, 20, 20, False), "PartialOverlap"),
        (("s", None, 22, 28, None, True), ("s", 23, 23, 24, 24, False), "CompleteOverlap"),
        (("s", 1, 22, 28, 40, True), ("s", 5, 5, 35, 35, False), "OuterOverlap"),
        (("s", 1, None, None, 40, True), ("s", 5, 5, 35, 35, False), "NoOverlap"),
    ]
    df = spark.createDataFrame([(a, b) for a, b, _ in rows], f"v struct<{LOC.replace(' ', ':').replace(',:', ',')}>, f struct<{LOC.replace(' ', ':').replace(',:', ',')}>")
    assert [r[0] for r in df.select(intervals.overlap_kind()).collect()] == [k for *_, k in rows] == [kind(a, b) for a, b, _ in rows]


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10**6))
def test_overlaps_equal_brute_force(spark, seed):
    r = random.Random(seed)

    def rows(n, width, prefix):
        out = []
        for i in range(n):
            s = r.randrange(0, 200_000)
            e = s + r.randrange(0, width)
            pad = r.choice([0, 0, 0, 500])
            out.append((f"{prefix}{i}", f"s{r.randrange(3)}", s - pad, s, e, e + pad, pad > 0))
        return out

    v, f = rows(60, r.choice([50, 50_000, 5_000_000]), "v"), rows(60, 20_000, "f")
    vd, fd = spark.createDataFrame(v, f"variant string, {LOC}"), spark.createDataFrame(f, f"feature string, {LOC}").withColumn("ftype", F.lit("Gene"))
    want = set()
    for a in v:
        for b in f:
            lo, hi = a[2], max(a[2] + 500_000, a[5])
            if a[1] == b[1] and any(lo <= c <= hi for c in b[2:6]) and kind(a[1:], b[1:]) != "NoOverlap" and a[2] <= b[5] and b[2] <= a[5]:
                want.add((a[0], b[0], kind(a[1:], b[1:])))
    assert {tuple(x) for x in intervals.overlaps(vd, fd).collect()} == want


def test_strict_mode_takes_equal_intervals_as_complete(spark):
    v = spark.createDataFrame([("v", "s", 1, 1, 9, 9, False)], f"variant string, {LOC}")
    f = spark.createDataFrame([("f", "s", 1, 1, 9, 9, False)], f"feature string, {LOC}").withColumn("ftype", F.lit("Gene"))
    assert intervals.overlaps(v, f, "strict").collect() == [("v", "f", "CompleteOverlap")]
    assert intervals.overlaps(v, f).collect() == []


def test_closure_ends_on_cycles_and_equals_python(spark):
    r = random.Random(3)
    edges = [(f"n{r.randrange(12)}", f"n{r.randrange(12)}") for _ in range(18)]
    reach = {}
    for a in {x for e in edges for x in e}:
        seen, front, d = {}, {a}, 0
        while front:
            d += 1
            front = {q for p, q in edges if p in front} - seen.keys()
            seen.update(dict.fromkeys(front, d))
        reach[a] = seen
    got = {(x.node, x.ancestor): x.depth for x in graph.closure(spark.createDataFrame(edges, "child string, parent string")).collect()}
    assert got == {(a, b): d for a, s in reach.items() for b, d in s.items()}


def test_empty_inputs(spark):
    e = spark.createDataFrame([], "child string, parent string")
    assert graph.closure(e).count() == 0
    v = spark.createDataFrame([], f"variant string, {LOC}")
    f = spark.createDataFrame([], f"feature string, {LOC}").withColumn("ftype", F.lit("Gene"))
    assert intervals.overlaps(v, f).count() == 0 and intervals.candidates(v, f).count() == 0
    s = spark.createDataFrame([], "assertion string, gene string")
    a = spark.createDataFrame([], "assertion string, copy_change string, direction string")
    assert conflicts.variant_conflicts(a, s).count() == 0


def test_lof_score_example(spark):
    o = spark.createDataFrame([("v", "a", "CompleteOverlap"), ("v", "b", "CompleteOverlap"), ("v", "c", "PartialOverlap"), ("w", "x", "CompleteOverlap")], "variant string, feature string, kind string")
    lof = spark.createDataFrame([("a", 0.5), ("b", 0.5), ("c", 0.9)], "gene string, lower95 double")
    got = {r.variant: r.score for r in scores.lof_scores(o, lof).collect()}
    assert set(got) == {"v"} and abs(got["v"] - 1.0986123) < 1e-6


def test_patterns_join_on_shared_variables(spark):
    t = spark.createDataFrame([("a", "p", "b"), ("b", "q", "c"), ("x", "p", "y"), ("l", "p", "l")], "s string, p string, o string")
    assert patterns.bgp(t, ("?x", "p", "?y"), ("?y", "q", "?z")).collect() == [("b", "a", "c")]
    assert patterns.scan(t, "?x", "p", "?x").collect() == [("l",)]
    assert patterns.ask(patterns.scan(t, "?x", "none")).first()[0] is False


def test_snapshot_comparison(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 1), (3, "z", 1)], "k int, a string, b int")
    b = spark.createDataFrame([(1, "x", None), (2, "y", 2), (4, "z", 1)], "k int, a string, b int")
    assert {tuple(r[:2]) + (tuple(r[2]),) for r in filters.compare_snapshots(a, b, "k").collect()} == {(1, "same", ()), (2, "changed", ("b",)), (3, "only_old", ()), (4, "only_new", ())}


def test_variant_descriptions(spark):
    cols = "build chrom start start_min start_max end end_min end_max svtype".split()
    rows = [
        ("19", "1", None, "900", "1000", None, "2000", "2010", "DEL"), ("hg19", "chr1", None, "900", "1000", None, "2000", "2010", "Deletion"),
        ("19", "1", None, "900", "900", None, "2000", "2000", "DEL"), ("19", "1", "900", None, None, "2000", None, None, "DEL"),
        ("hg17", "1", "1", None, None, "2", None, None, "DEL"), ("19", "chrZZ", "1", None, None, "2", None, None, "DEL"), ("19", "1", "5", None, None, "2", None, None, "DEL"),
        ("19", "1", "1", None, None, "2", None, None, "INV"), ("19", "1", "-1", None, None, "2", None, None, "DEL"), ("19", "1", "1.5", None, None, "2", None, None, "DEL"), ("19", "1", None, None, "5", None, None, "9", "DUP"),
    ]
    valid, rejects = builders.build_variants(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols)))
    got = valid.select("start_min", "start", "is_range", "variant").collect()
    assert len(got) == 4 and len({r.variant for r in got}) == 2  # synonyms, and equal min and max, give equal ids
    assert rejects.count() == 7 and rejects.where("size(reasons) = 0").count() == 0


def test_triples_of_nested_rows(spark):
    df = spark.createDataFrame([("a", "label", ("p", "g"), ["x", "y"], None)], "iri string, name string, subject struct<iri:string, gene:string>, tags array<string>, none string")
    got = {(r.s, r.p, r.o, r.o_kind) for r in builders.to_triples(df, "g", kind="T", literals=("name",)).collect()}
    assert got == {("a", "rdf:type", "T", "iri"), ("a", "name", "label", "literal"), ("a", "subject", "p", "iri"), ("p", "gene", "g", "iri"), ("a", "tags", "x", "iri"), ("a", "tags", "y", "iri")}


def test_embedding_job_normalises(spark):
    import numpy as np

    df = spark.createDataFrame([(1, "ab"), (2, None)], "k long, t string")
    got = {r.k: list(r.vector) for r in search.embed(df, "k", "t", lambda xs: np.array([[3.0 * len(x), 4.0 * len(x)] for x in xs])).collect()}
    assert [round(x, 6) for x in got[1]] == [0.6, 0.8] and got[2] == [0.0, 0.0]


def test_related_counts_equal_pairs_over_all_assertions(spark):
    rng = random.Random(9)
    stated = [(f"a{i}", rng.choice(["loss", "gain"]), rng.choice(["Supports", "Refutes", "Inconclusive"])) for i in range(120)]
    sets = [(a, f"g{g}") for a, _, _ in stated for g in rng.sample(range(12), rng.randint(1, 6))]
    assertions, genes = spark.createDataFrame(stated, "assertion string, copy_change string, direction string"), spark.createDataFrame(sets, "assertion string, gene string")
    want = collections.Counter(a for a, _ in map(tuple, conflicts.related_assertions(assertions, genes).collect()))
    for most in (10, 3):  # 3: larger sets go gene by gene
        got = {x.assertion: x.n_related for x in conflicts.related_counts(assertions, genes, most).collect()}
        assert got == {a: want[a] for a, _, _ in stated} and sum(got.values())


def test_shared_counts_equal_brute_force(spark):
    sets = {"a": "12", "b": "123", "c": "34", "d": "5", "e": "12"}
    rows = spark.createDataFrame([(k, g) for k, v in sets.items() for g in v], "assertion string, gene string")
    members, groups = conflicts.gene_groups(rows)
    name = {x.group: sets[x.assertion] for x in members.collect()}
    got = {(name[x.group], name[x.other]): (x.n, x.n_other, x.shared) for x in conflicts.shared_counts(groups).collect()}
    assert got == {(a, b): (len(a), len(b), len(set(a) & set(b))) for a in name.values() for b in name.values() if set(a) & set(b)}


def test_set_similarity_queries_cover_the_whole_table(spark, sf):
    from helixframe import plans

    got = plans.QUERIES["j10_shared_gene_sets"](spark, sf).collect()
    sizes = {x.n: x.n_sets for x in plans.QUERIES["j10_shared_gene_sizes"](spark, sf).collect()}
    whole = lambda x: x.subset and x.superset
    assert {x.n: x.n_pairs for x in got if whole(x)} == sizes  # each set is met by itself
    assert any(x.subset and not x.superset for x in got) and all(x.fraction == x.shared / x.n for x in got)
    assert plans.QUERIES["x20_containment_inconclusive"](spark, sf).count() == 2


def test_dates_and_counts_take_all_rows(spark):
    from helixframe import plans

    sf = "/root/testdata/sf0.1"
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    days = plans.QUERIES["c16_epoch_days"](spark, sf)
    assert (days.count(), days.where("day is null").count()) == (orders.count(), 0)
    got = plans.QUERIES["j13_full_outer_orders"](spark, sf).agg(F.sum("n_orders"), F.sum("n_lines")).first()
    assert tuple(got) == (orders.count(), spark.read.parquet(f"{sf}/lineitem.parquet").count())


def test_nearest_takes_more_queries_than_a_block(spark, sf):
    from helixframe import plans

    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    asked = v.where("vec_id % 10 = 0")
    run = lambda most: sorted(map(tuple, search.nearest(v, asked, "vec_id", "embedding", "label", 2, most).collect()))
    whole = run(10_000)
    assert run(7) == whole and len({x[0] for x in whole}) == asked.count() > 7
    got = {x["query"] for x in plans.QUERIES["t5_nearest_all"](spark, sf).collect()}
    assert got == {x.vec_id for x in v.where("vec_id % 50 = 0").collect()}


def test_closure_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(110)], "child long, parent long")
    got = graph.closure(edges).groupBy().agg(F.count("*"), F.max("depth"), F.sum(F.col("ancestor") - F.col("node") - F.col("depth"))).first()
    assert tuple(got) == (110 * 111 // 2, 110, 0)


def test_candidates_of_more_than_a_thousand_feature_types(spark):
    loc = "seq_ref string, start_outer long, start_inner long, end_inner long, end_outer long, is_range boolean"
    f = spark.createDataFrame([(f"f{i}", f"type{i}" if i % 2 else "Gene", "s", 10 + i, 10 + i, 20 + i, 20 + i, False) for i in range(2400)], f"feature string, ftype string, {loc}")
    v = spark.createDataFrame([("v", "s", 5, 5, 3000, 3000, False), ("w", "s", 100_000, 100_000, 100_001, 100_001, False), ("u", "s", None, None, 9, 9, False)], f"variant string, {loc}")
    got = {(r.variant, r.feature) for r in intervals.candidates(v, f).collect()}
    assert got == {("v", f"f{i}") for i in range(2400)}


def test_overlaps_of_keys_with_one_location_need_no_grouping(spark, sf):
    from helixframe import plans
    from helixframe.plans import core, registry

    f, v = core.located(registry.Source(spark, sf))
    rows = lambda one: sorted(map(tuple, intervals.overlaps(v, f, one_location=one).collect()))
    assert rows(True) == rows(False) and len(rows(True)) == plans.QUERIES["x2_overlaps"](spark, sf).count()


def test_filter_bits_equal_the_filters_one_by_one(spark, sf):
    from helixframe.operators import filters, reports
    from helixframe.plans import core, registry

    m = core.model(registry.Source(spark, sf))
    calls = [("complete_overlap_with_feature_set", "ARGene"), ("partial_overlap_with_feature_set", "HaploinsufficiencyFeatures"), ("has_annotation", None), ("copy_change", "loss"), ("gene_count_min", "Genes25")]
    bits = {r.assertion: r.bits for r in filters.filter_bits(m, calls).select("assertion", "bits").collect()}
    for i, (f, a) in enumerate(calls):
        want = {r.assertion for r in filters.apply_filters(m, [{"filter": f, "argument": a}]).collect()}
        assert {k for k, b in bits.items() if b >> i & 1} == want
    union = {"u": [("copy_change", "loss", "exists"), ("has_annotation", None, "union"), ("date_evaluated_min", "1996", "difference")]}
    want = filters.apply_filters(m, [{"filter": f, "argument": a, "operation": o} for f, a, o in union["u"]]).count()
    assert sum(r.n for r in reports.case_mix(m, union).collect()) == want > 0


def test_top_and_other_of_ties_nulls_and_few_groups(spark):
    from helixframe.operators import aggregates

    df = spark.createDataFrame([("a", 5), ("b", 5), (None, 5), ("d", 1), ("e", 2)], "k string, n long")
    assert sorted(map(tuple, aggregates.top_and_other(df, 2, "k").collect()), key=str) == sorted([(None, 5), ("a", 5), ("other", 8)], key=str)
    assert sorted(map(tuple, aggregates.top_and_other(df.where("k > 'c'"), 9, "k").collect())) == [("d", 1), ("e", 2)]
