"""Record scans over file ranges, set-similarity joins against brute force, residual categories, response diffs, quarterly versions."""

import gzip
import random
import re

import pytest
from pyspark.sql import functions as F

from helixframe.operators import conflicts, filters, reports, responses
from helixframe.sources import files, records

# ---- S1, S2 ------------------------------------------------------------------------------------------------------


def naive_outermost(text, tag):
    """Elements of the tag by depth."""
    out, depth, start = [], 0, 0
    for m in re.finditer(rf"""<{tag}(/|\s(?:[^<>"']|"[^"]*"|'[^']*')*)?>|</{tag}>""", text):
        if m[0].startswith("</"):
            depth -= 1
            if depth == 0:
                out.append(text[start : m.end()])
        elif m[0].endswith("/>"):
            if depth == 0:
                out.append(m[0])
        else:
            if depth == 0:
                start = m.start()
            depth += 1
    return sorted(out)


def element(rng, depth, inside=("text\n", "é ", "<name/>")):
    attributes = rng.choice(["", ' id="7"', " a='>' b=\"<x>\"", "\n x=\"1\""])
    if rng.random() < 0.2:
        return f"<gene{attributes}/>"
    inner = "".join(rng.choice(inside) if depth == 0 or rng.random() < 0.6 else element(rng, depth - 1, inside) for _ in range(rng.randrange(5)))
    return f"<gene{attributes}>{inner}</gene>"


@pytest.fixture
def small_blocks(spark):
    """Scans of 500 bytes a task."""
    names = {"spark.sql.files.maxPartitionBytes": "500", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_records_are_read_by_ranges_and_kept_whole(spark, tmp_path, small_blocks):
    rng = random.Random(4)
    flat, deep = [], []
    for i in range(3):
        flat.append("<Release>" + "".join(element(rng, 0) + rng.choice(["", "\n", "<other/>"]) for _ in range(60)) + "</Release>")
        deep.append("<Release>\n" + "".join(element(rng, 3, ("text\n", "é ", "<genes>x</genes>", "<name/>")) + rng.choice(["", " ", "<genes>q</genes>"]) for _ in range(60)) + rng.choice(["</Release>", "<gene>without an end"]))
        (tmp_path / f"flat{i}.xml").write_text(flat[-1])
        (tmp_path / f"deep{i}.xml").write_text(deep[-1])
    got = records.split_records(spark, f"{tmp_path}/flat*.xml", "gene", simple=True)
    assert got.rdd.getNumPartitions() > 6  # several tasks a file
    assert sorted(r.record for r in got.collect()) == sorted(x for t in flat for x in naive_outermost(t, "gene"))
    got = records.split_records(spark, f"{tmp_path}/deep*.xml", "gene")
    assert sorted(r.record for r in got.collect()) == sorted(x for t in deep for x in naive_outermost(t, "gene"))
    (tmp_path / "none.xml").write_text("")
    assert records.split_records(spark, f"{tmp_path}/none.xml", "gene").count() == records.split_records(spark, f"{tmp_path}/none.xml", "gene", simple=True).count() == 0


def test_chunks_by_delimiter_and_pattern(spark, tmp_path, small_blocks):
    entries = [f"## entry {i}\nvalue={i}\n" + ("x" * (i % 90)) + "\n" for i in range(80)]
    (tmp_path / "log.txt").write_text("head\n" + "".join(entries))
    got = records.split_chunks(spark, str(tmp_path / "log.txt"), "## entry ", r"(?s)## entry \d+\nvalue=\d+")
    assert sorted(r.record for r in got.collect()) == sorted(f"## entry {i}\nvalue={i}" for i in range(80))


def test_archives_are_cut_before_they_are_parsed(spark, tmp_path, small_blocks):
    one = lambda i: f'<VariationArchive Accession="VCV{i}" Version="2"><ClassifiedRecord><SimpleAllele AlleleID="{i}" VariationID="{i}"><Name>n &lt; {i}</Name></SimpleAllele></ClassifiedRecord></VariationArchive>'
    text = "<Release>" + "\n".join(map(one, range(50))) + "</Release>"
    (tmp_path / "a.xml").write_text(text)
    with gzip.open(tmp_path / "b.xml.gz", "wt") as f:
        f.write(text)
    for name in ("a.xml", "b.xml.gz"):
        rows = files.load_archive(spark, str(tmp_path / name), partitions=4).collect()
        assert sorted((r.vcv_id, r.variation_id, r.name) for r in rows) == sorted((f"VCV{i}", str(i), f"n < {i}") for i in range(50))


# ---- J10, X18, X20 -----------------------------------------------------------------------------------------------


def gene_sets(rng, n, genes=30, hot=0.7):
    return [(f"a{i}", sorted({f"g{min(int(rng.expovariate(0.15)), genes)}" for _ in range(rng.randint(1, 9))} | ({"hot"} if rng.random() < hot else set()))) for i in range(n)]


def exploded(spark, sets, key="assertion"):
    return spark.createDataFrame([(k, g) for k, gs in sets for g in gs], f"{key} string, gene string")


def test_similar_sets_against_every_pair(spark):
    sets = gene_sets(random.Random(7), 150)
    members, groups = conflicts.gene_groups(exploded(spark, sets))
    groups = groups.cache()
    distinct = [set(x) for x in {tuple(gs) for _, gs in sets}]
    genes = {r.group: set(r.genes) for r in groups.collect()}
    told = lambda df: sorted((sorted(genes[r.group]), sorted(genes[r.other]), r.shared) for r in df.collect())
    for share in (1.0, 0.6):
        want = sorted((sorted(a), sorted(b), len(a & b)) for a in distinct for b in distinct if len(a & b) >= share * len(a) - 1e-9)
        assert told(conflicts.contained_sets(groups, groups, share)) == want
    for least in (0.3, 0.8):
        want = sorted(sorted([sorted(a), sorted(b)]) + [len(a & b)] for i, a in enumerate(distinct) for b in distinct[i + 1 :] if len(a & b) >= least * len(a | b) - 1e-9)
        assert sorted(sorted(x[:2]) + [x[2]] for x in told(conflicts.jaccard_sets(groups, least))) == want


def test_a_hot_gene_makes_few_candidates(spark):
    """1,000 sets share one gene and little else: their pairs are 500,000, those that are compared a few thousand."""
    sets = [(f"a{i}", ["hot", f"x{i % 500}", f"y{i}", f"z{i}"]) for i in range(1000)]
    groups = conflicts.gene_groups(exploded(spark, sets))[1].cache()
    df = conflicts.jaccard_sets(groups, 0.3)
    assert df.count() == 500  # the pairs that share an x
    plan = df._jdf.queryExecution()
    plan.executedPlan().executeCollect()
    counts = [int(x.replace(",", "")) for x in re.findall(r"number of output rows: ([\d,]+)", plan.executedPlan().toString())]
    assert not counts or max(counts) < 20_000
    least = F.ceil(F.col("n") * 0.3)
    assert conflicts._prefixes(groups, groups.select(F.explode("genes").alias("gene")).groupBy("gene").agg(F.count("*").alias("often")), F.col("n") - least + 1, []).where("gene = 'hot'").count() == 0


def test_region_matches_against_every_pair(spark):
    rng = random.Random(9)
    regions = [(f"r{i}", gs) for i, (_, gs) in enumerate(gene_sets(rng, 40))]
    variants = [(f"v{i}", list(rng.choice(regions)[1]) if rng.random() < 0.5 else gs) for i, (_, gs) in enumerate(gene_sets(rng, 80))]
    for slack, share in ((0.05, 0.9), (0.4, 0.5)):
        want = sorted((r, v) for r, a in regions for v, b in variants if abs(len(b) - len(a)) <= int(len(a) * slack + 0.5) and len(set(a) & set(b)) >= share * len(b) - 1e-9)
        got = conflicts.region_matches(exploded(spark, regions, "region"), exploded(spark, variants, "variant"), slack, share)
        assert sorted(map(tuple, got.collect())) == want and want


def test_residual_categories_hold_every_assertion_once(spark):
    rng = random.Random(11)
    sets = gene_sets(rng, 200, genes=8, hot=0.3)
    facts = [(k, rng.choice(["loss", "gain", None]), rng.choice(["Supports", "Refutes", "Inconclusive"])) for k, _ in sets] + [("bare", "loss", "Refutes")]
    hits = [(k, rng.choice(["haplo", "triplo"]), rng.choice(["CompleteOverlap", "PartialOverlap", "OuterOverlap"])) for k, _ in sets if rng.random() < 0.3]
    got = conflicts.residual_categories(spark.createDataFrame(facts, "assertion string, copy_change string, direction string"), exploded(spark, sets), spark.createDataFrame(hits, "assertion string, feature_set string, kind string")).collect()
    assert sorted(r.assertion for r in got) == sorted(k for k, *_ in facts)
    has = {k: {(s, kind) for a, s, kind in hits if a == k} for k, *_ in facts}
    genes, mapped = {k: frozenset(g) for k, g in sets}, {}
    for k, c, d in facts:
        if d != "Supports" and c == "loss":
            mapped[k] = "complete_haploinsufficient" if ("haplo", "CompleteOverlap") in has[k] else "partial_haploinsufficient" if ("haplo", "PartialOverlap") in has[k] else None
        elif d != "Supports" and c == "gain":
            mapped[k] = "complete_triplosensitive" if ("triplo", "CompleteOverlap") in has[k] else None
    for r in got:
        c, d = next((c, d) for k, c, d in facts if k == r.assertion)
        if mapped.get(r.assertion):
            want = (mapped[r.assertion], None)
        elif r.assertion not in genes:
            want = ("no_genes", None)
        else:
            own = genes[r.assertion]
            partners = [genes[k] for k, c2, d2 in facts if k in genes and c2 is not None and c2 == c and (d2 == "Supports") != (d == "Supports") and not mapped.get(k)]
            if d == "Supports":
                inside = [len(p) for p in partners if own <= p]
                want = ("within_a_residual_set", min(inside)) if inside else ("none", None)
            else:
                held = [len(p) for p in partners if p <= own]
                want = ("holds_a_pathogenic_set", max(held)) if held else ("none", None)
        assert (r.category, r.best) == want, r
    assert len({r.category for r in got}) >= 6


# ---- X21, X22 ----------------------------------------------------------------------------------------------------


def test_combinations_take_one_interval_join_and_none_is_empty(spark):
    from helixframe.plans.core import cnv_model
    from helixframe.plans.registry import Source

    t = Source(spark, "/root/testdata/sf0.01")
    mix = reports.case_mix(cnv_model(t))
    assert {r.combination for r in mix.collect()} == set(reports.COMBINATIONS) and len(reports.COMBINATIONS) == 11
    plan = mix._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("greatest(FLOOR") + plan.count("greatest(floor") <= 2  # the bin of a pair: once for the interval join
    m = cnv_model(t)
    ours = {r.assertion for r in reports.combination(m, reports.GOLD_STANDARD).collect()}
    counted = filters.intervals.gene_count_criteria(filters.intervals.overlaps(m.variants, m.features, one_location=True))
    from dataclasses import replace

    one_by_one = filters.apply_filters(replace(m, criteria=counted), [{"filter": f, "argument": a, "operation": o} for f, a, o in reports.GOLD_STANDARD])
    assert ours == {r.assertion for r in one_by_one.collect()} and ours


# ---- X37, X31 ----------------------------------------------------------------------------------------------------

RESPONSE = "struct<name:string, score:double, items:array<struct<id:long, tags:array<string>>>, more:map<string,array<long>>>"


def shuffled(rng, value):
    if isinstance(value, list):
        return rng.sample([shuffled(rng, x) for x in value], len(value))
    if isinstance(value, tuple):
        return tuple(shuffled(rng, x) for x in value)
    return {k: shuffled(rng, x) for k, x in value.items()} if isinstance(value, dict) else value


def test_order_of_arrays_is_no_difference_and_one_leaf_is(spark):
    rng = random.Random(5)
    old = [(i, (f"n{i}", i / 3, [(j, [rng.choice("abc") for _ in range(4)]) for j in range(5)], {"k": [1, 2, 2], "l": None})) for i in range(40)] + [(40, None), (41, ("x", None, None, None)), (42, ("only", 1.0, [], {}))]
    new = [(i, shuffled(rng, r)) for i, r in old if i != 42] + [(43, ("new", 1.0, [], {}))]
    new[7] = (7, ("n7", 7 / 3, [*new[7][1][2][:-1], (99, new[7][1][2][-1][1])], new[7][1][3]))
    new[8] = (8, ("n8", 8 / 3, new[8][1][2], {"k": [2, 1], "l": None}))  # a repeated item less
    frame = lambda rows: spark.createDataFrame(rows, f"key long, response {RESPONSE}")
    states = {r.key: r.state for r in responses.response_states(frame(old), frame(new)).collect()}
    assert {k for k, s in states.items() if s != "same"} == {7, 8, 42, 43} and states[7] == states[8] == "changed" and states[42] == "only_old" and states[43] == "only_new"
    as_sets = {r.key: r.state for r in responses.response_states(frame(old), frame(new), distinct=True).collect()}
    assert as_sets[8] == "same" and as_sets[7] == "changed"
    moved = {(r.key, r.path, r.value, r.n_old, r.n_new) for r in responses.leaf_differences(frame(old), frame(new)).collect()}
    gone = next(iter({j for j, _ in old[7][1][2]} - {j for j, _ in new[7][1][2]}))
    assert moved == {(7, "items[].id", f"bigint:{gone}", 1, 0), (7, "items[].id", "bigint:99", 0, 1), (8, "more<>[]", "bigint:2", 2, 1)}
    asked = spark.createDataFrame([(i, "even" if i % 2 == 0 else "odd") for i in range(44)], "key long, query string")
    assert {(r.query, r.n, r.n_different) for r in responses.discrepancies(responses.response_states(frame(old), frame(new)), asked).collect()} == {("even", 22, 2), ("odd", 22, 2)}
    renamed = responses.response_states(frame([(1, ("CG:A", 1.0, [], {}))]), frame([(1, ("X:A", 1.0, [], {}))]), rewrites={"CG:A": "X:A"})
    assert renamed.first().state == "same"


def test_versions_count_by_a_first_version_in_their_quarter(spark):
    rows = [(1, "r", "1.0", "2025-01-02"), (2, "r", "1.1", "2025-02-02"), (3, "r", "1.2", "2025-05-02"), (4, "r", "10.0", "2025-08-01"), (5, "s", "1.10", "2025-01-09"), (6, "s", None, "2025-01-09"), (7, "r", "2.0", None), (8, None, "1.1", "2025-01-01"), (9, None, "3.0", "2025-01-01")]
    v = spark.createDataFrame(rows, "curation long, record string, version string, date string").withColumn("date", F.col("date").cast("date"))
    quarter = F.concat(F.year("date").cast("string"), F.lit("Q"), F.quarter("date").cast("string"))
    assert sorted(r.curation for r in reports.counted_versions(v, quarter).collect()) == [1, 2, 4, 9]
    roles = spark.createDataFrame([(1, "Approver", "b"), (1, "Approver", "a"), (2, "Approver", "a"), (2, "SecondaryContributor", "c"), (3, "Approver", "z"), (4, "Approver", None)], "curation long, role string, agent string")
    got = {(r.quarter, r.agent, r.approvals, r.secondary) for r in reports.quarterly_productivity(v, roles, quarter).collect()}
    assert got == {("2025Q1", "a", 2, 0), ("2025Q1", "c", 0, 1)}


# ---- J8 ----------------------------------------------------------------------------------------------------------


def test_interval_join_against_every_pair_and_few_rows_for_wide_ones(spark):
    from helixframe.operators import intervals

    rng = random.Random(13)

    def side(n):
        out = []
        for i in range(n):
            start = rng.randrange(250_000_000)
            out.append((f"k{i}", rng.choice(["s1", "s2", None]), start, start + int(10 ** rng.uniform(-1, 8.4)) if rng.random() < 0.95 else None))
        return [*out, ("whole", "s1", 0, 249_000_000), ("back", "s1", 500, 400), ("point", "s1", 7, 7)]

    left, right = side(120), side(120)
    columns = "key string, seq_ref string, start_outer long, end_outer long"
    frame = lambda rows: spark.createDataFrame(rows, columns)
    for a, b in ((left, right), (left[:3], right), (left, right[-3:-2]), (left, [])):
        want = sorted((x[0], y[0]) for x in a for y in b if None not in x and None not in y and x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3])
        got = intervals.interval_join(frame(a), frame(b))
        assert sorted((r.v_key, r.f_key) for r in got.collect()) == want
    wide = frame([("whole", "s1", 0, 249_000_000)]).withColumn("_own", intervals._own_level(F.col("end_outer") - F.col("start_outer")))
    assert wide.first()._own == 1 << 26  # four bins, and one or two at wider levels
