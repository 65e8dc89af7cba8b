"""Curation reports on rows with nulls, ties and missing partners."""


from helixframe.operators import curation_reports as C
from helixframe.operators import conflicts


def test_points_by_year_takes_the_last_dated_version(spark):
    versions = spark.createDataFrame([("r", 1, "1.0", "2020-01-01", "Limited", 10), ("r", 2, "1.1", "2021-01-01", "Moderate", 12), ("old", 3, "1.0", "2020-01-01", "Limited", 5), ("bare", 4, "1.0", "2020-01-01", "Limited", 5)], "record string, curation long, version string, ts string, classification string, total long")
    lines = spark.createDataFrame([(1, "p1", 3, False), (2, "p1", 3, False), (2, "p2", 4, True), (2, "p9", 1, None), (2, None, 2, True), (3, "p0", 5, False)], "curation long, paper string, points long, segregation boolean")
    papers = spark.createDataFrame([("p1", 2001), ("p2", 2003), ("p0", 1999), ("p9", None)], "paper string, year long")
    rows = C.points_by_year(versions, lines, papers).collect()
    assert [r.record for r in rows] == ["r"]
    r = rows[0]
    assert (r.curation, r.earliest, r.segregation_points, r.difference, r.y2001, r.y2002, r.y2003) == (2, 2001, 6, 12 - 8, 3, 0, 4)
    assert [(v.version, v.classification) for v in r.versions] == [("1.0", "Limited"), ("1.1", "Moderate")]


def test_recurations_by_role(spark):
    versions = spark.createDataFrame([(1, ["cg:NewCuration", "cg:RecurationTiming"]), (2, ["cg:RecurationTiming"]), (3, ["other"]), (4, None), (5, ["cg:RecurationNewEvidence", None])], "curation long, reasons array<string>")
    roles = spark.createDataFrame([(1, "Approver", "b", "2020"), (1, "Approver", "a", "2021"), (2, "Approver", "a", None), (2, "SecondaryContributor", "s", "x"), (3, "Approver", "a", "x"), (5, "Approver", None, "x")], "curation long, role string, agent string, date string")
    assert [tuple(r) for r in C.recurations(versions, roles, "Approver").collect()] == [("a", 1, 1)]
    assert [tuple(r) for r in C.recurations(versions, roles, "SecondaryContributor").collect()] == [("s", 0, 1)]


def test_version_sheets_and_probands(spark):
    cols = "record string, version string, date string, classification string, total long, genetic long, experimental long, gene string, disease string, moi string, earliest long"
    row = lambda r, v, c: (r, v, f"d{v}", c, 1, 2, 3, "g", f"dis{v}", "AD", 2000)
    df = spark.createDataFrame([row("a", "1.0", "x"), row("a", "1.9", "y"), row("a", "2.0", "z"), row("b", "1.0", "x"), row("c", "2.0", "only one"), row("d", None, "no number")], cols)
    again = C.version_sheet(df, True).collect()
    assert [(r.record, r.disease, [v.classification for v in r.versions]) for r in again] == [("a", "dis2.0", ["y", "z"])]
    assert sorted(r.record for r in C.version_sheet(df, False).collect()) == ["b", "d"]
    s = spark.createDataFrame([("s1", "AD", "Limited"), ("s2", "AD", "Limited"), ("s3", None, None)], "stmt string, moi string, classification string")
    evidence = spark.createDataFrame([("s1", "e1"), ("e1", "e2"), ("e2", "e1"), ("s2", "p9")], "child string, parent string")
    counts = C.probands(s, evidence, spark.createDataFrame([("p1", "e2"), ("p2", "e2"), ("x", "e1")], "s string, o string"), spark.createDataFrame([("p1",), ("p2",), ("p9",), ("p9",)], "node string"))
    assert {tuple(r) for r in counts.collect()} == {("s1", 2), ("s2", 1), ("s3", 0)}
    told = {(r.moi, r.classification): (r.mean, r.median, r.least, r.most, r.n) for r in C.proband_statistics(s, counts).collect()}
    assert told == {("AD", "Limited"): (1.5, 1.5, 1, 2, 2), (None, None): (0.0, 0.0, 0, 0, 1)}


def test_assertions_about_types_and_groups(spark):
    p = spark.createDataFrame([("p1", "A", "g", None, "g"), ("p2", "B", None, "f", None), ("p3", "A", None, None, None)], "proposition string, type string, gene string, feature string, subject string")
    a = spark.createDataFrame([("a1", "p1"), ("a2", "p1"), ("a3", "p2"), ("a4", "p3")], "assertion string, proposition string")
    gone = spark.createDataFrame([("a2",), (None,)], "assertion string")
    assert {tuple(r) for r in C.assertions_about(p, a, gone).collect()} == {("g", "a1"), ("f", "a3")}
    assert {tuple(r) for r in C.assertions_about(p, a, gone, "B").collect()} == {("f", "a3")}
    types = spark.createDataFrame([("n1", "cg:X"), ("n1", "skos:C"), ("n2", "skos:C"), ("n3", None)], "node string, type string")
    assert [tuple(r) for r in C.entity_types(types, spark.createDataFrame([("skos:C", "Concept")], "node string, label string"), "cg:").where("type is not null").collect()] == [("skos:C", "Concept", 2)]
    facts = spark.createDataFrame([("x", "loss", "Supports"), ("y", "loss", "Refutes"), ("z", "loss", "Refutes")], "assertion string, copy_change string, direction string")
    sets = spark.createDataFrame([("x", "g1"), ("y", "g1"), ("y", "g2"), ("z", "g1"), ("z", "g2")], "assertion string, gene string")
    pairs, left, right = conflicts.conflict_groups(facts, sets)
    assert pairs.count() == 1 and left.count() == 1 and right.count() == 2  # one pair of sets for two pairs of assertions
    assert {tuple(r) for r in conflicts.variant_conflicts(facts, sets).collect()} == {("x", "y"), ("x", "z")}
