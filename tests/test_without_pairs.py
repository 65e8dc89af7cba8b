"""Queries whose rows are fewer than pairs of overlaps make no pairs, and still give their SQL's rows."""

import os

import duckdb
import pytest

from helixframe import plans
from helixframe.operators import intervals

SF = "/root/testdata/sf0.001"
NAMES = [
    "f22_coding_variants",
    "x15_lof_scores",
    "x16_deletion_scores",
    "x20_residual_categories",
    "a3_gene_count_criteria",
    "nf6_gene_count_min",
    "x21_simple_mix",
    "x22_gold_standard",
    "x21_case_mix",
    "j9_candidates",
    "x1_overlap_kinds",
    "st7_rejected_regions",
    "f7_filter_conjunction",
    "nf5_partial_overlap",
    "nf4_complete_overlap",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return con


def cell(v):
    return "~" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)


def rows_of(spark, con, name):
    df, r = plans.QUERIES[name](spark, SF), con.sql(plans.SQL[name])
    order = sorted(r.columns)
    assert order == sorted(df.columns)
    return sorted(tuple(cell(x[c]) for c in order) for x in df.collect()), sorted(tuple(cell(x[r.columns.index(c)]) for c in order) for x in r.fetchall())


@pytest.mark.parametrize("name", NAMES)
def test_no_pairs_are_made(spark, duck, name, monkeypatch):
    def pairs(*_, **__):
        raise AssertionError("pairs are made")

    monkeypatch.setattr(intervals, "interval_join", pairs)
    monkeypatch.setattr(intervals, "candidates", pairs)
    ours, theirs = rows_of(spark, duck, name)
    assert ours == theirs


def test_scores_of_odd_factors(spark):
    """Zeros, factors below zero, missing and unusual ones, several rows of a gene: as the product of the factors has them."""
    from pyspark.sql import functions as F

    from helixframe.operators import scores

    loc = "start_outer long, start_inner long, end_inner long, end_outer long, is_range boolean"
    genes = {"a": [0.3], "b": [1.0], "c": [1.5], "d": [None], "e": [float("nan")], "f": [float("inf")], "g": [0.999999] * 3, "h": [0.0], "i": [1.5, 0.2], "j": [1e-7]}
    lof = spark.createDataFrame([(g, x) for g, xs in genes.items() for x in xs], "gene string, lower95 double")
    f = spark.createDataFrame([(g, "Gene", "s", 1_000 * i, 1_000 * i, 1_000 * i + 10, 1_000 * i + 10, False) for i, g in enumerate(genes)], f"feature string, ftype string, seq_ref string, {loc}")
    v = spark.createDataFrame([(f"{i}-{j}", "s", x := 1_000 * i - 5, x, y := 1_000 * j + 20, y, False) for i in range(10) for j in range(i, 10)], f"variant string, seq_ref string, {loc}")
    pairs = scores.lof_scores(intervals.overlaps(v, f, one_location=True), lof)
    told = lambda df: {r[0]: cell(r[1]) for r in df.select("variant", F.round("score", 6)).collect()}
    assert told(scores.lof_scores_of(v, f, lof)) == told(pairs)


@pytest.mark.parametrize("name", ["j10_jaccard_sets", "j10_shared_gene_sets"])
def test_no_pairs_of_gene_sets_by_single_genes(spark, duck, name, monkeypatch):
    from helixframe.operators import conflicts

    def pairs(*_, **__):
        raise AssertionError("pairs are made")

    monkeypatch.setattr(conflicts, "similar_sets", pairs)
    monkeypatch.setattr(conflicts, "shared_counts", pairs)
    ours, theirs = rows_of(spark, duck, name)
    assert ours == theirs


@pytest.mark.parametrize("name, table", [("x24_annotated_conflicts", "annotations")])
def test_only_asked_variants_are_joined(spark, duck, name, table, monkeypatch):
    join, seen = intervals.interval_join, []

    def watched(variants, features):
        seen.append(variants.count())
        return join(variants, features)

    monkeypatch.setattr(intervals, "interval_join", watched)
    ours, theirs = rows_of(spark, duck, name)
    assert ours == theirs
    from helixframe.plans.registry import Source

    assert seen == [getattr(Source(spark, SF), table).count()]


def test_pairs_of_regions_with_one_location_are_not_shuffled_for_their_best_kind(spark, monkeypatch):
    join, seen = intervals.overlaps, []

    def watched(*args, **named):
        seen.append(named.get("one_location"))
        return join(*args, **named)

    monkeypatch.setattr(intervals, "overlaps", watched)
    plans.QUERIES["st6_enriched_regions"](spark, SF).count()
    assert seen == [True]


@pytest.mark.parametrize("name", ["g20_feature_variants", "x7_dosage_conflicts", "x8_region_conflicts"])
def test_pairs_meet_no_further_join(spark, name):
    """The topmost join is that of the locations."""
    df = plans.QUERIES[name](spark, SF)
    lines = df._jdf.queryExecution().optimizedPlan().toString().split("\n")
    first = next(i for i, x in enumerate(lines) if "Join" in x)
    assert "start_outer" in lines[first] and "bin" in lines[first]
