"""Queries: reports on statements, their evidence, papers and contributors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vocab
from ..operators import curation_reports as C
from .registry import Source, query
from .views import with_views

_text = lambda *parts: F.concat(*[F.lit(p) if not p.startswith("$") else F.col(p[1:]).cast("string") for p in parts])

# ---- X30: orders as versions of their customers' records, lines as evidence, suppliers as papers -----------------

_YEARS = range(2000, 2026)
_EVIDENCE = """WITH l AS (SELECT l_orderkey AS curation, l_suppkey AS paper, CAST(l_quantity AS BIGINT) AS points, l_returnflag = 'R' AS seg FROM lineitem),
p AS (SELECT s_suppkey AS paper, 1998 + s_suppkey % 31 AS year FROM supplier)"""


def papers(t: Source):
    return t.supplier.select(F.col("s_suppkey").alias("paper"), (F.lit(1998) + F.col("s_suppkey") % 31).alias("year"))


query("x30_points_by_year", _EVIDENCE + f""",
e AS (SELECT curation, min(year) AS earliest, coalesce(sum(points) FILTER (WHERE seg), 0) AS segregation_points, sum(points) FILTER (WHERE l.paper IS NOT NULL) AS paper_points,
  {', '.join(f'coalesce(sum(points) FILTER (WHERE year = {y}), 0) AS y{y}' for y in _YEARS)} FROM l LEFT JOIN p ON l.paper = p.paper GROUP BY curation),
v AS (SELECT o_custkey AS record, o_orderkey AS curation, concat('v', o_orderkey % 9) AS version, o_orderdate AS ts, o_orderstatus AS classification, CAST(floor(o_totalprice) AS BIGINT) AS total, e.* EXCLUDE (curation)
  FROM orders JOIN e ON o_orderkey = e.curation WHERE earliest >= 2000),
i AS (SELECT record, string_agg(concat_ws(' ', version, classification, total), '; ' ORDER BY ts, curation) AS versions FROM v GROUP BY record)
SELECT v.record, v.curation, v.version, v.classification, v.total, v.earliest, CAST(v.segregation_points AS BIGINT) AS segregation_points, CAST(total - paper_points AS BIGINT) AS difference, {', '.join(f'CAST(y{y} AS BIGINT) AS y{y}' for y in _YEARS)}, i.versions
FROM v JOIN i ON v.record = i.record QUALIFY row_number() OVER (PARTITION BY v.record ORDER BY ts DESC, curation DESC) = 1""")(
    lambda t: C.points_by_year(
        t.orders.select(F.col("o_custkey").alias("record"), F.col("o_orderkey").alias("curation"), F.concat(F.lit("v"), (F.col("o_orderkey") % 9).cast("string")).alias("version"), F.col("o_orderdate").alias("ts"), F.col("o_orderstatus").alias("classification"), F.floor("o_totalprice").cast("long").alias("total")),
        t.lineitem.select(F.col("l_orderkey").alias("curation"), F.col("l_suppkey").alias("paper"), F.col("l_quantity").cast("long").alias("points"), (F.col("l_returnflag") == "R").alias("segregation")),
        papers(t),
    ).withColumn("versions", F.array_join(F.transform("versions", lambda x: F.concat_ws(" ", x["version"], x["classification"], x["total"].cast("string"))), "; "))
)

# ---- X28 ---------------------------------------------------------------------------------------------------------


def recurations(t: Source):
    """Orders as versions with reasons; every one has an approver, every third a secondary contributor."""
    k = F.col("o_orderkey")
    reason = F.when(F.col("o_orderpriority") == "1-URGENT", F.array(F.lit("cg:NewCuration"), F.lit("cg:RecurationTiming"))).when(F.col("o_orderpriority") == "2-HIGH", F.array(F.lit("cg:RecurationNewEvidence"))).when(F.col("o_orderpriority") == "3-MEDIUM", F.array(F.lit("cg:Other")))
    versions = t.orders.select(k.alias("curation"), reason.alias("reasons"))
    who = lambda role, n: t.orders.select(k.alias("curation"), F.lit(role).alias("role"), F.concat(F.lit("panel:"), (F.col("o_custkey") % n).cast("string")).alias("agent"), F.col("o_orderdate").alias("date"))
    roles = who("Approver", 10).unionByName(who("SecondaryContributor", 7).where("curation % 3 = 0"))
    each = [C.recurations(versions, roles, role).withColumn("role", F.lit(role)) for role in ("Approver", "SecondaryContributor")]
    return each[0].unionByName(each[1])


_REASONS = "count_if(o_orderpriority = '1-URGENT') AS n_new, count_if(o_orderpriority = '2-HIGH') AS n_again"
_NAMED = "WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')"
query("x28_recurations_by_role", f"SELECT concat('panel:', o_custkey % 10) AS agent, {_REASONS}, 'Approver' AS role FROM orders {_NAMED} GROUP BY ALL UNION ALL SELECT concat('panel:', o_custkey % 7), {_REASONS}, 'SecondaryContributor' FROM orders {_NAMED} AND o_orderkey % 3 = 0 GROUP BY ALL")(recurations)

# ---- X27, X33, X34: statements about genes; the lines that name their part are their evidence --------------------

_CLASS = "CASE WHEN p_partkey % 11 = 0 THEN 'Disputed' WHEN p_partkey % 13 = 0 THEN 'Refuted' WHEN p_size % 2 = 0 THEN 'Limited' ELSE 'Strong' END"


def statements(t: Source):
    return t.part.select(
        F.concat(F.lit("gv:"), "p_partkey").alias("stmt"), F.concat(F.lit("G"), "p_partkey").alias("gene"), F.col("p_type").alias("disease"), F.when(F.col("p_partkey") % 3 == 0, "AD").otherwise("AR").alias("moi"),
        F.expr(_CLASS).alias("classification"), F.col("p_size").cast("long").alias("overall"), F.concat((F.col("p_partkey") % 4).cast("string"), F.lit(".0")).alias("version"),
    )


query("x27_weak_statements", f"""WITH s AS (SELECT p_partkey AS k, concat('G', p_partkey) AS gene, p_type AS disease, CASE WHEN p_partkey % 3 = 0 THEN 'AD' ELSE 'AR' END AS moi, {_CLASS} AS classification, CAST(p_size AS BIGINT) AS overall, concat(p_partkey % 4, '.0') AS version FROM part),
e AS (SELECT l_partkey AS k, CAST(max(l_quantity) FILTER (WHERE l_linestatus = 'F') AS BIGINT) AS genetic, CAST(max(l_quantity) FILTER (WHERE l_linestatus <> 'F') AS BIGINT) AS experimental FROM lineitem GROUP BY ALL),
c AS (SELECT DISTINCT l_partkey AS k, l_suppkey AS paper, 1998 + s_suppkey % 31 AS year FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
f AS (SELECT k, paper, year FROM c QUALIFY row_number() OVER (PARTITION BY k ORDER BY year, paper) = 1)
SELECT gene, disease, moi, classification, CASE WHEN s.k % 5 <> 0 THEN concat('panel:', s.k % 9) END AS gcep, CASE WHEN s.k % 5 <> 0 THEN concat('20', 10 + s.k % 9, '-01-01') END AS approval_date, paper AS first_publication, year AS publication_date, overall, genetic, experimental, version
FROM s LEFT JOIN e ON s.k = e.k LEFT JOIN f ON s.k = f.k WHERE classification IN ('Limited', 'Disputed', 'Refuted')""")(
    lambda t: C.weak_statements(
        statements(t),
        t.lineitem.select(F.concat(F.lit("gv:"), "l_partkey").alias("stmt"), F.when(F.col("l_linestatus") == "F", "genetic").otherwise("experimental").alias("criteria"), F.col("l_quantity").cast("long").alias("score")),
        t.part.where("p_partkey % 5 <> 0").select(F.concat(F.lit("gv:"), "p_partkey").alias("stmt"), F.lit("Approver").alias("role"), F.concat(F.lit("panel:"), (F.col("p_partkey") % 9).cast("string")).alias("agent"), F.concat(F.lit("20"), (F.col("p_partkey") % 9 + 10).cast("string"), F.lit("-01-01")).alias("date")),
        t.lineitem.select(F.concat(F.lit("gv:"), "l_partkey").alias("stmt"), F.col("l_suppkey").alias("paper")),
        papers(t).withColumnRenamed("year", "date"),
    )
)
query("x33_best_candidates", with_views("validity", "mechanism") + """, c AS (SELECT * FROM validity WHERE strength IN ('Moderate', 'Strong', 'Definitive') AND CAST(split_part(gene, ':', 2) AS BIGINT) % 6 = 1
UNION ALL SELECT concat(stmt, 'b'), gene, concat(disease, ' b'), moi, 'Moderate' FROM validity WHERE strength IN ('Moderate', 'Strong', 'Definitive') AND CAST(split_part(gene, ':', 2) AS BIGINT) % 6 = 1 AND moi = 'AR')
SELECT gene, strength, disease, count(*) OVER (PARTITION BY gene) > 1 AS several FROM c QUALIFY row_number() OVER (PARTITION BY gene ORDER BY CASE strength WHEN 'Definitive' THEN 0 WHEN 'Strong' THEN 1 ELSE 2 END, disease) = 1""")(
    lambda t: C.best_candidates(
        t.validity.unionByName(t.validity.where("moi = 'AR' and strength in ('Moderate', 'Strong', 'Definitive')").withColumns({"stmt": F.concat("stmt", F.lit("b")), "disease": F.concat("disease", F.lit(" b")), "strength": F.lit("Moderate")})),
        t.mechanism.where(F.split_part("feature", F.lit(":"), F.lit(2)).cast("long") % 6 != 1), [s for s in vocab.STRENGTH_ORDER],
    )
)


def _probands(t: Source):
    """Statements whose evidence are orders of their part; customers of orders are the items with that variant, every other one a proband."""
    s = statements(t)
    evidence = t.lineitem.select(F.concat(F.lit("gv:"), "l_partkey").alias("child"), F.concat(F.lit("order:"), "l_orderkey").alias("parent"))
    links = t.orders.select(F.concat(F.lit("cust:"), "o_custkey").alias("s"), F.concat(F.lit("order:"), "o_orderkey").alias("o"))
    items = t.customer.where("c_custkey % 2 = 0").select(F.concat(F.lit("cust:"), "c_custkey").alias("node"))
    return s, C.probands(s, evidence, links, items)


_PROBANDS = f"""WITH s AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN 'AD' ELSE 'AR' END AS moi, {_CLASS} AS classification FROM part),
n AS (SELECT l_partkey AS k, count(DISTINCT o_custkey) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey % 2 = 0 GROUP BY ALL)"""
query("x34_probands", _PROBANDS + " SELECT concat('gv:', s.k) AS stmt, coalesce(n.n, 0) AS n FROM s LEFT JOIN n ON s.k = n.k")(lambda t: _probands(t)[1])
query("x34_proband_statistics", _PROBANDS + " SELECT moi, classification, round(avg(coalesce(n.n, 0)), 6) AS mean, median(coalesce(n.n, 0)) AS median, min(coalesce(n.n, 0)) AS least, max(coalesce(n.n, 0)) AS most, count(*) AS n FROM s LEFT JOIN n ON s.k = n.k GROUP BY ALL")(lambda t: C.proband_statistics(*_probands(t)))

# ---- X38 ---------------------------------------------------------------------------------------------------------


def _statistics(t: Source):
    """Orders as reports of one of two groups, their lines as parts and scores; orders of status P failed early."""
    k, adult = F.col("o_orderkey").alias("report"), F.col("o_custkey") % 2 == 0
    group = F.when(adult, C.ADULT).otherwise(C.PAEDIATRIC).alias("agent")
    roles = t.orders.select(k, F.lit("EvidenceRole").alias("role"), group).unionByName(t.orders.where("o_orderkey % 3 <> 0").select(k, F.lit("ApproverRole").alias("role"), group))
    parts = t.lineitem.select(F.col("l_orderkey").alias("report"), F.col("l_partkey").alias("gene"), F.col("l_suppkey").alias("disease"))
    scores = t.lineitem.select(F.col("l_orderkey").alias("report"), F.col("l_linenumber").cast("long").alias("score"))
    reports = t.orders.select(k, F.concat((F.col("o_orderkey") % 4 + 1).cast("string"), F.lit(".0.0")).alias("version"))
    return C.curation_statistics(reports, roles, parts, scores, t.orders.where("o_orderstatus = 'P'").select(k))


def _by_group(name: str, cond: str) -> str:
    return f"""UNION ALL SELECT '{name}_gene_disease_pairs', CAST(count(*) AS VARCHAR) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM l WHERE {cond})
UNION ALL SELECT '{name}_scores', string_agg(concat(score, '=', n), ' ' ORDER BY score) FROM (SELECT l_linenumber AS score, count(*) AS n FROM l WHERE {cond} AND o_orderkey % 3 <> 0 GROUP BY ALL)
UNION ALL SELECT '{name}_outcome_intervention_pairs', CAST(count(*) AS VARCHAR) FROM l WHERE {cond} AND o_orderkey % 3 <> 0
UNION ALL SELECT '{name}_failed_early_rule_out', CAST(sum(CASE WHEN o_orderkey % 3 <> 0 THEN 2 ELSE 1 END) AS VARCHAR) FROM orders WHERE {cond} AND o_orderstatus = 'P'
"""


query("x38_actionability_statistics", f"""WITH l AS (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT 'reports' AS statistic, CAST(count(*) AS VARCHAR) AS value FROM orders UNION ALL SELECT 'updated_reports', CAST(count_if(o_orderkey % 4 <> 0) AS VARCHAR) FROM orders
UNION ALL SELECT 'gene_disease_pairs', CAST(count(*) AS VARCHAR) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM l) UNION ALL SELECT 'outcome_intervention_pairs', CAST(count(*) AS VARCHAR) FROM l WHERE o_orderkey % 3 <> 0
{_by_group('adult', 'o_custkey % 2 = 0')}{_by_group('paediatric', 'o_custkey % 2 <> 0')}""")(_statistics)

# ---- X29, X17, X13, X42 ------------------------------------------------------------------------------------------

_NUMBERED = """WITH v AS (SELECT o_custkey AS record, concat((row_number() OVER w - 1) // 9 + 1, '.', (row_number() OVER w - 1) % 9) AS version, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS date, o_orderstatus AS classification,
  CAST(floor(o_totalprice) AS BIGINT) AS total, o_orderkey % 12 AS genetic, o_orderkey % 6 AS experimental, concat('G', o_custkey) AS gene, o_orderpriority AS disease, CASE WHEN o_custkey % 2 = 0 THEN 'AD' ELSE 'AR' END AS moi, year(o_orderdate) - 3 AS earliest
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
k AS (SELECT record, count(*) AS n, bool_or(version[1] <> '1') AS again FROM v GROUP BY record),
m AS (SELECT v.* FROM v QUALIFY row_number() OVER (PARTITION BY record, version[1] ORDER BY version DESC) = 1)"""
_SHEET = """ SELECT record, max_by(gene, version) AS gene, max_by(disease, version) AS disease, max_by(moi, version) AS moi, CAST(max_by(earliest, version) AS INTEGER) AS earliest,
string_agg(concat_ws(' ', date, classification, total, genetic, experimental), '; ' ORDER BY version[1]) AS versions FROM m WHERE record IN (SELECT record FROM k WHERE {}) GROUP BY record"""


def sheet(t: Source, recurated: bool):
    """Orders as versions of their customers' records: nine minor versions to a major one."""
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1
    k = F.col("o_orderkey")
    v = t.orders.select(
        F.col("o_custkey").alias("record"), F.concat_ws(".", (F.floor(rank / 9) + 1).cast("string"), (rank % 9).cast("string")).alias("version"), F.date_format(F.col("o_orderdate").cast("date"), "yyyy-MM-dd").alias("date"),
        F.col("o_orderstatus").alias("classification"), F.floor("o_totalprice").cast("long").alias("total"), (k % 12).alias("genetic"), (k % 6).alias("experimental"), F.concat(F.lit("G"), "o_custkey").alias("gene"),
        F.col("o_orderpriority").alias("disease"), F.when(F.col("o_custkey") % 2 == 0, "AD").otherwise("AR").alias("moi"), (F.year("o_orderdate") - 3).alias("earliest"),
    )
    line = lambda x: F.concat_ws(" ", x["date"], x["classification"], x["total"].cast("string"), x["genetic"].cast("string"), x["experimental"].cast("string"))
    return C.version_sheet(v, recurated).withColumn("versions", F.array_join(F.transform("versions", line), "; "))


query("x29_recurated_sheet", _NUMBERED + _SHEET.format("n > 1 AND again"))(lambda t: sheet(t, True))
query("x29_not_recurated_sheet", _NUMBERED + _SHEET.format("NOT again"))(lambda t: sheet(t, False))

_SHARED = "SELECT concat('gene:', l_partkey) AS gene, CASE l_returnflag WHEN 'R' THEN 'AR' WHEN 'A' THEN 'AD' ELSE 'XL' END AS moi FROM lineitem WHERE l_linenumber = 1"
query("x17_inheritance_table", with_views("lof", "features", "mechanism", "validity") + f""", g AS ({_SHARED}) SELECT l.gene, f.symbol, l.lower95 AS score, (SELECT min(strength) FROM mechanism m WHERE m.mechanism = 'Haploinsufficiency' AND m.feature = l.gene) AS haplo,
coalesce((SELECT string_agg(moi, ',' ORDER BY moi) FROM validity v WHERE v.gene = l.gene), '') AS moi, coalesce((SELECT string_agg(moi, ',' ORDER BY moi) FROM g WHERE g.gene = l.gene), '') AS shared_moi FROM lof l LEFT JOIN features f ON f.feature = l.gene""")(
    lambda t: C.inheritance_table(
        t.lof, t.features, t.mechanism, t.validity,
        t.lineitem.where("l_linenumber = 1").select(F.concat(F.lit("gene:"), "l_partkey").alias("gene"), F.when(F.col("l_returnflag") == "R", "AR").when(F.col("l_returnflag") == "A", "AD").otherwise("XL").alias("moi")),
    ).withColumns({c: F.array_join(c, ",") for c in ("moi", "shared_moi")})
)


def about(t: Source, proposition_type: str | None):
    """Statements on validity name a gene, those on mechanism a feature, annotations their subject."""
    none = F.lit(None).cast("string")
    rows = lambda df, key, kind, **names: df.select(F.concat(F.lit("p:"), key).alias("proposition"), F.lit(kind).alias("type"), *[names.get(c, none).alias(c) for c in ("gene", "feature", "subject")], F.col(key).alias("assertion"))
    v = rows(t.validity, "stmt", "GeneValidityProposition", gene=F.col("gene"), subject=F.col("gene")).unionByName(rows(t.mechanism, "mech", "MechanismProposition", feature=F.col("feature"))).unionByName(rows(t.annotations, "annotation", "AnnotationProposition", subject=F.col("subject")))
    gone = t.mechanism.where("strength = 'DosageNoEvidence'").select(F.col("mech").alias("assertion")).unionByName(t.annotations.where("classification = 'NoAssessment'").select(F.col("annotation").alias("assertion")))
    return C.assertions_about(v, v.select("assertion", "proposition"), gone, proposition_type)


_ABOUT = with_views("validity", "mechanism", "annotations")
query("x13_assertions_about", _ABOUT + """ SELECT gene AS feature, stmt AS assertion FROM validity UNION SELECT feature, mech FROM mechanism WHERE strength <> 'DosageNoEvidence' UNION SELECT subject, annotation FROM annotations WHERE classification <> 'NoAssessment'""")(lambda t: about(t, None))
query("x13_assertions_of_type", _ABOUT + " SELECT DISTINCT feature, mech AS assertion FROM mechanism WHERE strength <> 'DosageNoEvidence'")(lambda t: about(t, "MechanismProposition"))
query("x42_entity_types", with_views("triples") + " SELECT o AS type, CASE WHEN o <> 'BUILDING' THEN concat('segment ', lower(o)) END AS label, count(DISTINCT s) AS n FROM triples WHERE p = 'rdf:type' AND NOT starts_with(o, 'Order') GROUP BY o")(
    lambda t: C.entity_types(
        t.triples.where("p = 'rdf:type'").select(F.col("s").alias("node"), F.col("o").alias("type")),
        t.customer.where("c_mktsegment <> 'BUILDING'").select(F.col("c_mktsegment").alias("node"), F.concat(F.lit("segment "), F.lower("c_mktsegment")).alias("label")), "Order",
    )
)
