"""Queries: curation reports and dashboards."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import conflicts, filters, reports, responses
from .analytics import versions
from .core import _REGIONS, ALL, CNVS, cnv_model, model, overlaps, overlaps_of_assertions, region_sets
from .registry import Source, query
from .views import with_views

_H = "(SELECT feature FROM mechanism WHERE mechanism = 'Haploinsufficiency' AND strength = 'DosageSufficientEvidence')"
_T = "(SELECT feature FROM mechanism WHERE mechanism = 'Triplosensitivity' AND strength = 'DosageSufficientEvidence')"
_ADXL = "(SELECT gene FROM validity WHERE strength IN ('Moderate', 'Strong', 'Definitive') AND moi IN ('AD', 'XL'))"
_AR = "(SELECT gene FROM validity WHERE strength IN ('Moderate', 'Strong', 'Definitive') AND moi = 'AR' UNION SELECT feature FROM mechanism WHERE strength = 'DosageAutosomalRecessive')"
_PC = "(SELECT feature FROM features WHERE protein_coding)"


def _over(kind, sub, no=""):
    return f"variant {no} IN (SELECT variant FROM olap WHERE kind = '{kind}' AND feature IN {sub})"


_LOSS, _GAIN = ("variant IN (SELECT variant FROM variants WHERE copy_change = '%s')" % c for c in ("loss", "gain"))
_WHERE = {
    "supported_losses": f"{_LOSS} AND direction = 'Supports'",
    "supported_gains": f"{_GAIN} AND direction = 'Supports'",
    "losses_over_haploinsufficient": f"{_LOSS} AND {_over('CompleteOverlap', _H)}",
    "gains_over_triplosensitive": f"{_GAIN} AND {_over('CompleteOverlap', _T)}",
    "losses_without_haploinsufficient": f"{_LOSS} AND {_over('CompleteOverlap', _H, 'NOT')}",
    "partial_over_haploinsufficient": f"{_LOSS} AND {_over('PartialOverlap', _H)}",
    "losses_over_moderate_adxl": f"{_LOSS} AND {_over('CompleteOverlap', _ADXL)}",
    "losses_over_recessive": f"{_LOSS} AND {_over('CompleteOverlap', _AR)}",
    "no_coding_gene": f"{_over('CompleteOverlap', _PC, 'NOT')} AND {_over('PartialOverlap', _PC, 'NOT')}",
    "recent": "'1997' < date_last_evaluated",
    "annotated": "assertion IN (SELECT subject FROM annotations)",
    "gold_standard": f"{_LOSS} AND direction = 'Supports' AND {_over('CompleteOverlap', _H)} AND '1995' < date_last_evaluated AND assertion NOT IN (SELECT subject FROM annotations)",
}
query("x21_simple_mix", ALL + " UNION ALL ".join(f" SELECT '{k}' AS combination, classification, count(*) AS n FROM assertions WHERE {w} GROUP BY classification" for k, w in _WHERE.items()))(
    lambda t: reports.case_mix(model(t), reports.SIMPLE_COMBINATIONS)
)

#: The same conditions for SQL: (filter, argument) -> condition on a row of assertions.
_SETS = {"HaploinsufficiencyFeatures": _H, "TriplosensitivityFeatures": _T, "GeneValidityModerateAndGreaterADXL": _ADXL, "ARGene": _AR, "ProteinCodingGenes": _PC}


def _condition(name: str, argument: str | None) -> str:
    if name in filters.OVERLAP_KINDS:
        return f"variant IN (SELECT variant FROM olap WHERE kind = '{filters.OVERLAP_KINDS[name]}' AND feature IN {_SETS[argument]})"
    return {
        "proposition_type": "direction <> 'Refutes'",
        "copy_change": f"variant IN (SELECT variant FROM variants WHERE copy_change = '{argument}')",
        "gene_count_min": f"variant IN (SELECT variant FROM olap WHERE kind = 'CompleteOverlap' GROUP BY variant HAVING count(*) >= {(argument or '')[5:] or 0})",
        "assertion_direction": f"direction = '{argument}'",
        "submitter": f"submitter = '{argument}'",
        "date_evaluated_min": f"coalesce('{argument}' < date_last_evaluated, false)",
        "has_annotation": "assertion IN (SELECT subject FROM annotations)",
    }[name]


def _all_of(calls) -> str:
    return " AND ".join(f"{'NOT ' if op == 'not_exists' else ''}({_condition(f, a)})" for f, a, op in calls)


query("x21_case_mix", CNVS + " UNION ALL ".join(f" SELECT '{k}' AS combination, classification, count(*) AS n FROM assertions WHERE {_all_of(c)} GROUP BY classification" for k, c in reports.COMBINATIONS.items()))(lambda t: reports.case_mix(cnv_model(t)))
query("x22_gold_standard", CNVS + f" SELECT assertion FROM assertions WHERE {_all_of(reports.GOLD_STANDARD)}")(lambda t: reports.combination(cnv_model(t), reports.GOLD_STANDARD))
query("x13_about_feature", ALL + """ SELECT DISTINCT feature, stmt AS assertion FROM (SELECT gene AS feature, stmt FROM validity UNION SELECT feature, mech FROM mechanism) WHERE stmt NOT IN (SELECT mech FROM mechanism WHERE strength = 'DosageNoEvidence')""")(
    lambda t: reports.about_feature([t.validity.select(F.col("gene").alias("feature"), F.col("stmt").alias("assertion")), t.mechanism.select("feature", F.col("mech").alias("assertion"))], t.mechanism.where("strength = 'DosageNoEvidence'").select(F.col("mech").alias("assertion")))
)
query("x19_region_report", _REGIONS + """, m AS (SELECT region, variant FROM (SELECT r.region, v.variant, count(*) AS shared FROM r JOIN v ON r.gene = v.gene GROUP BY ALL) JOIN rn USING (region) JOIN vn USING (variant) WHERE abs(vn.n - rn.n) <= floor(rn.n * 0.05 + 0.5) AND shared >= 0.9 * vn.n),
f AS (SELECT concat('scv:', o_orderkey) AS variant, CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH','3-MEDIUM') THEN 'loss' ELSE 'gain' END AS cc, CASE o_orderstatus WHEN 'F' THEN 'Supports' WHEN 'O' THEN 'Inconclusive' ELSE 'Refutes' END AS d FROM orders)
SELECT region, """ + ", ".join(f"count_if(cc = '{c}' AND d = '{d}') AS \"{c}_{d}\"" for c in ("loss", "gain") for d in ("Supports", "Inconclusive", "Refutes")) + " FROM m JOIN f USING (variant) GROUP BY region")(
    lambda t: reports.region_report(conflicts.region_matches(*region_sets(t)), t.assertions.join(t.variants, "variant").select(F.col("assertion").alias("variant"), "copy_change", "direction"))
)
query("x23_submissions", ALL + """ SELECT '2000-01-01' AS date_created, concat('VCV', k, '.1') AS vcv, concat('SCV', k, '.1') AS scv, CAST(k AS VARCHAR) AS variation_id, split_part(submitter, ':', 2) AS submitter_id, 'flagging candidate' AS action, 'Conflict with the dosage map' AS reason,
concat('This submission was flagged because its interpretation of this variant conflicts with the dosage map ', CASE WHEN n > 1 THEN 'curations ' ELSE 'curation ' END, 'for ', CASE WHEN n = 1 THEN 'the gene' ELSE 'the following genes:' END, ' ', gs, '.') AS notes
FROM (SELECT CAST(split_part(a.assertion, ':', 2) AS BIGINT) AS k, a.submitter, count(*) AS n, array_to_string(list_slice(list(g.gene ORDER BY g.gene), 1, 10), ' ') AS gs FROM annotations x JOIN assertions a ON x.subject = a.assertion JOIN gene_sets g ON g.assertion = a.assertion WHERE x.classification = 'DosageMapConflict' GROUP BY ALL)""")(
    lambda t: reports.submission_rows(
        t.annotations.where("classification = 'DosageMapConflict'").select(F.col("subject").alias("assertion")).join(t.assertions, "assertion").join(t.gene_sets.groupBy("assertion").agg(F.sort_array(F.collect_set("gene")).alias("genes")), "assertion")
        .withColumn("k", F.split_part("assertion", F.lit(":"), F.lit(2))).select(F.concat(F.lit("x:SCV"), "k").alias("assertion"), F.lit("1").alias("version"), "variant", F.concat(F.lit("VCV"), "k").alias("vcv"), F.lit("1").alias("vcv_version"), "submitter", "genes"),
        "Conflict with the dosage map", "2000-01-01",
    )[0]
)
query("x24_annotated_conflicts", ALL + """ SELECT x.annotation, a.assertion, x.classification, coalesce((SELECT string_agg(DISTINCT f.symbol, ' ' ORDER BY f.symbol) FROM olap o JOIN features f ON o.feature = f.feature WHERE o.kind = 'CompleteOverlap' AND o.variant = a.variant), '') AS genes FROM annotations x JOIN assertions a ON x.subject = a.assertion""")(
    lambda t: reports.annotated_conflicts(t.annotations, t.assertions, overlaps_of_assertions(t, t.annotations.select(F.col("subject").alias("assertion"))), t.features)
)
query("x25_leaderboard", ALL + " SELECT submitter, count(*) AS n FROM assertions WHERE assertion IN (SELECT subject FROM annotations) GROUP BY submitter")(lambda t: reports.leaderboard(t.annotations, t.assertions))
query("x26_moderate_ad_mentions", ALL + " SELECT v.stmt, v.gene, coalesce(l.lower95, 0) AS score FROM validity v LEFT JOIN lof l ON v.gene = l.gene WHERE v.moi = 'AD' AND v.strength IN ('Moderate', 'Strong', 'Definitive') AND contains(lower(v.disease), 'promo')")(
    lambda t: reports.dominant_mentions(t.validity, t.lof.select("gene", F.col("lower95").alias("score")), "PROMO")
)
query("x27_limited_report", ALL + " SELECT v.stmt, f.symbol, v.disease, v.moi, m.mechanism, m.strength AS dosage FROM validity v JOIN features f ON v.gene = f.feature LEFT JOIN mechanism m ON m.feature = v.gene WHERE v.strength = 'Limited'")(
    lambda t: t.validity.where("strength = 'Limited'").join(t.features.select(F.col("feature").alias("gene"), "symbol"), "gene").join(t.mechanism.select(F.col("feature").alias("gene"), "mechanism", F.col("strength").alias("dosage")), "gene", "left").select("stmt", "symbol", "disease", "moi", "mechanism", "dosage")
)
query("x28_recuration", "SELECT o_custkey AS affiliation, count_if(o_orderpriority = '1-URGENT' OR o_orderstatus = 'F') AS n_new, count_if((o_orderpriority = '2-HIGH' OR o_orderstatus = 'O') AND NOT (o_orderpriority = '1-URGENT' OR o_orderstatus = 'F')) AS n_again FROM orders GROUP BY o_custkey")(
    lambda t: reports.recuration(t.orders.select(F.col("o_custkey").alias("affiliation"), F.array("o_orderpriority", "o_orderstatus").alias("reasons")), {"new": ["1-URGENT", "F"], "again": ["2-HIGH", "O"]})
)
query("x29_recurated_records", "SELECT conv_id, count(DISTINCT CAST(floor(turn / 3) AS BIGINT)) AS n_major FROM conversations GROUP BY conv_id HAVING count(DISTINCT CAST(floor(turn / 3) AS BIGINT)) > 1")(
    lambda t: versions(t).groupBy("conv_id").agg(F.countDistinct(F.split_part("version", F.lit("."), F.lit(1))).alias("n_major")).where("n_major > 1")
)
query("x30_points_by_paper", "SELECT o_orderkey AS curation, CAST(round(o_totalprice) AS BIGINT) AS total, CAST(coalesce(p, 0) AS BIGINT) AS papers, CAST(round(o_totalprice) AS BIGINT) - CAST(coalesce(p, 0) AS BIGINT) AS difference FROM orders LEFT JOIN (SELECT l_orderkey, sum(CAST(l_quantity AS BIGINT)) AS p FROM lineitem GROUP BY ALL) ON l_orderkey = o_orderkey")(
    lambda t: reports.points_by_paper(t.lineitem.select(F.col("l_orderkey").alias("curation"), F.col("l_quantity").cast("long").alias("points")), t.orders.select(F.col("o_orderkey").alias("curation"), F.round("o_totalprice").cast("long").alias("total")))
)
query("x31_quarterly", """WITH a AS (SELECT concat(year(o_orderdate), 'Q', quarter(o_orderdate)) AS quarter, o_clerk AS agent, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL), b AS (SELECT concat(year(o_orderdate), 'Q', quarter(o_orderdate)) AS quarter, o_clerk AS agent, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL)
SELECT quarter, agent, coalesce(a.n, 0) AS approvals, coalesce(b.n, 0) AS secondary FROM a FULL JOIN b USING (quarter, agent)""".replace("o_clerk", "o_orderpriority"))(
    lambda t: reports.quarterly(*[t.orders.where(F.col("o_orderstatus") == s).select(F.concat(F.year("o_orderdate"), F.lit("Q"), F.quarter("o_orderdate")).alias("quarter"), F.col("o_orderpriority").alias("agent")) for s in "FO"])
)
query("x32_gene_report", ALL + """ SELECT f.feature, f.symbol, (SELECT min_by(strength, list_position(['Definitive', 'Strong', 'Moderate', 'Limited'], strength)) FROM validity v WHERE v.gene = f.feature) AS validity,
(SELECT min(strength) FROM mechanism m WHERE m.feature = f.feature AND mechanism = 'Haploinsufficiency') AS "Haploinsufficiency", (SELECT min(strength) FROM mechanism m WHERE m.feature = f.feature AND mechanism = 'Triplosensitivity') AS "Triplosensitivity",
coalesce(c.n_complete, 0) AS n_complete, coalesce(c.n_partial, 0) AS n_partial FROM features f LEFT JOIN (SELECT feature, count_if(kind = 'CompleteOverlap') AS n_complete, count_if(kind = 'PartialOverlap') AS n_partial FROM olap GROUP BY feature) c ON c.feature = f.feature""")(
    lambda t: reports.gene_report(t.features, t.validity, t.mechanism, overlaps(t).groupBy("feature").agg(F.count_if(F.col("kind") == "CompleteOverlap").alias("n_complete"), F.count_if(F.col("kind") == "PartialOverlap").alias("n_partial")))
)
query("x33_dosage_candidates", ALL + " SELECT stmt, gene, disease, moi, strength FROM validity WHERE strength IN ('Moderate', 'Strong', 'Definitive') AND gene NOT IN (SELECT feature FROM mechanism WHERE strength <> 'DosageNoEvidence')")(
    lambda t: reports.dosage_candidates(t.validity, t.mechanism.where("strength <> 'DosageNoEvidence'")).select("stmt", "gene", "disease", "moi", "strength")
)
query("x34_probands_by_mode", "SELECT c_mktsegment, o_orderpriority, round(avg(n), 6) AS mean, CAST(median(n) AS DOUBLE) AS median, min(n) AS least, max(n) AS most, count(*) AS n FROM (SELECT o_custkey, o_orderpriority, c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) GROUP BY c_mktsegment, o_orderpriority")(
    lambda t: A.statistics(t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("o_custkey", "o_orderpriority", "c_mktsegment").agg(F.count("*").alias("k")), "k", "c_mktsegment", "o_orderpriority")
)
query("x36_request_log", "SELECT event_type AS status, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS longest FROM events GROUP BY event_type")(lambda t: reports.request_statistics(t.events.select(F.col("event_type").alias("status"), F.col("value").alias("duration"))))
query("x36_slowest", "SELECT event_id, value FROM events WHERE event_type <> 'error' ORDER BY value DESC, event_id LIMIT 25")(lambda t: A.top(t.events.where("event_type <> 'error'").select("event_id", "value"), 25, "value", "event_id"))
query("x39_submissions_per_year", with_views("assertions") + " SELECT year, n, CAST(sum(n) OVER (ORDER BY year) AS BIGINT) AS total FROM (SELECT substr(date_last_evaluated, 1, 4) AS year, count(*) AS n FROM assertions WHERE date_last_evaluated IS NOT NULL GROUP BY ALL)")(lambda t: reports.yearly(t.assertions, "date_last_evaluated"))
query("x39_missing_dates", with_views("assertions") + " SELECT classification, count(*) AS n FROM assertions WHERE date_last_evaluated IS NULL GROUP BY ALL")(lambda t: A.frequencies(t.assertions.where("date_last_evaluated is null"), "classification"))
query("x40_differing_regions", with_views("gene_sets") + """, x AS (SELECT assertion AS region, gene FROM gene_sets WHERE CAST(split_part(gene, ':', 2) AS BIGINT) % 3 <> 0), y AS (SELECT assertion AS region, gene FROM gene_sets WHERE CAST(split_part(gene, ':', 2) AS BIGINT) % 5 <> 0)
SELECT r.region, coalesce((SELECT string_agg(gene, ',' ORDER BY gene) FROM x WHERE x.region = r.region AND gene NOT IN (SELECT gene FROM y WHERE y.region = r.region)), '') AS only_a, coalesce((SELECT string_agg(gene, ',' ORDER BY gene) FROM y WHERE y.region = r.region AND gene NOT IN (SELECT gene FROM x WHERE x.region = r.region)), '') AS only_b
FROM (SELECT DISTINCT region FROM ((SELECT * FROM x EXCEPT SELECT * FROM y) UNION (SELECT * FROM y EXCEPT SELECT * FROM x))) r""")(
    lambda t: (lambda n: reports.differing_regions(*[t.gene_sets.where(n % k != 0).withColumnRenamed("assertion", "region") for k in (3, 5)]))(F.split_part("gene", F.lit(":"), F.lit(2)).cast("long")).select("region", F.array_join("only_a", ",").alias("only_a"), F.array_join("only_b", ",").alias("only_b"))
)
query("x41_event_profile", "SELECT event_type, substr(CAST(ts AS VARCHAR), 1, 10) AS day, count(*) AS n FROM events GROUP BY ALL")(lambda t: A.frequencies(t.events.withColumn("day", F.date_format("ts", "yyyy-MM-dd")), "event_type", "day"))
query("x42_foreign_types", with_views("triples") + " SELECT DISTINCT o AS type FROM triples WHERE p = 'rdf:type' AND NOT starts_with(o, 'Order')")(lambda t: reports.foreign_types(t.triples.where("p = 'rdf:type'").select(F.col("o").alias("type")), "Order"))
query("x44_source_profile", with_views("assertions") + " SELECT 'classification' AS \"column\", classification AS value, count(*) AS n FROM assertions GROUP BY ALL UNION ALL SELECT 'review_status', review_status, count(*) FROM assertions GROUP BY ALL UNION ALL SELECT 'direction', direction, count(*) FROM assertions GROUP BY ALL")(
    lambda t: reports.profile(t.assertions, "classification", "review_status", "direction")
)
query("x38_curation_statistics", with_views("validity") + " SELECT moi, count(*) AS n_reports, count(DISTINCT concat(gene, '|', disease)) AS n_pairs, count_if(regexp_matches(disease, '^PROMO')) AS n_promo FROM validity GROUP BY moi")(
    lambda t: t.validity.groupBy("moi").agg(F.count("*").alias("n_reports"), F.countDistinct("gene", "disease").alias("n_pairs"), F.count_if(F.col("disease").rlike("^PROMO")).alias("n_promo"))
)
query("g13_curations_by_gene", ALL + " SELECT gene, stmt AS curation, 'validity' AS activity FROM validity UNION SELECT feature, mech, 'dosage' FROM mechanism")(
    lambda t: filters.union_distinct(t.validity.select("gene", F.col("stmt").alias("curation"), F.lit("validity").alias("activity")), t.mechanism.select(F.col("feature").alias("gene"), F.col("mech").alias("curation"), F.lit("dosage").alias("activity")))
)
query("g15_dosage_view", ALL + " SELECT feature, strength, CASE strength WHEN 'DosageSufficientEvidence' THEN 3 WHEN 'DosageModerateEvidence' THEN 2 WHEN 'DosageMinimalEvidence' THEN 1 WHEN 'DosageNoEvidence' THEN 0 WHEN 'DosageAutosomalRecessive' THEN 30 END AS ordinal, CASE mechanism WHEN 'Haploinsufficiency' THEN 1 ELSE 3 END AS copies FROM mechanism")(
    lambda t: t.mechanism.select("feature", "strength", F.when(F.col("strength") == "DosageSufficientEvidence", 3).when(F.col("strength") == "DosageModerateEvidence", 2).when(F.col("strength") == "DosageMinimalEvidence", 1).when(F.col("strength") == "DosageNoEvidence", 0).when(F.col("strength") == "DosageAutosomalRecessive", 30).alias("ordinal"), F.when(F.col("mechanism") == "Haploinsufficiency", 1).otherwise(3).alias("copies"))
)

# ---- versions by quarter, nested responses -----------------------------------------------------------------------

_QUARTER = "concat(year(date), 'Q', quarter(date))"
_ORDER_VERSIONS = """WITH v AS (SELECT o_orderkey AS curation, o_custkey AS record, CAST(o_orderdate AS DATE) AS date, concat('panel:', o_custkey % 30) AS clerk,
  concat((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1) // 3 + 1, '.', (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1) % 3) AS version FROM orders)"""


def _versions(t: Source):
    """Orders as versions of their customers' records: every third begins a major version."""
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1
    number = F.concat_ws(".", (F.floor(rank / 3) + 1).cast("string"), (rank % 3).cast("string"))
    return t.orders.select(F.col("o_orderkey").alias("curation"), F.col("o_custkey").alias("record"), F.col("o_orderdate").cast("date").alias("date"), number.alias("version"))


@query("x31_productivity", _ORDER_VERSIONS + f""", c AS (SELECT *, {_QUARTER} AS quarter FROM v),
k AS (SELECT c.* FROM c WHERE version LIKE '%.0' OR EXISTS (SELECT 1 FROM c z WHERE z.record = c.record AND z.quarter = c.quarter AND z.version LIKE '%.0')),
a AS (SELECT quarter, clerk AS agent, count(*) AS n FROM k WHERE curation % 5 <> 0 GROUP BY ALL), b AS (SELECT quarter, clerk AS agent, count(*) AS n FROM k WHERE curation % 5 = 0 OR curation % 7 = 0 GROUP BY ALL)
SELECT coalesce(a.quarter, b.quarter) AS quarter, coalesce(a.agent, b.agent) AS agent, coalesce(a.n, 0) AS approvals, coalesce(b.n, 0) AS secondary FROM a FULL JOIN b ON a.quarter = b.quarter AND a.agent = b.agent""")
def x31_productivity(t):
    k, clerk = F.col("o_orderkey"), F.concat(F.lit("panel:"), (F.col("o_custkey") % 30).cast("string")).alias("agent")
    roles = t.orders.where(k % 5 != 0).select(k.alias("curation"), F.lit("Approver").alias("role"), clerk)
    roles = roles.unionByName(t.orders.where((k % 5 == 0) | (k % 7 == 0)).select(k.alias("curation"), F.lit("SecondaryContributor").alias("role"), clerk))
    quarter = F.concat(F.year("date").cast("string"), F.lit("Q"), F.quarter("date").cast("string"))
    return reports.quarterly_productivity(_versions(t), roles, quarter)


query("x31_counted_versions", _ORDER_VERSIONS + f""", c AS (SELECT *, {_QUARTER} AS quarter FROM v)
SELECT curation, record, version, quarter FROM c WHERE version LIKE '%.0' OR EXISTS (SELECT 1 FROM c z WHERE z.record = c.record AND z.quarter = c.quarter AND z.version LIKE '%.0')""")(
    lambda t: reports.counted_versions(_versions(t), F.concat(F.year("date").cast("string"), F.lit("Q"), F.quarter("date").cast("string"))).select("curation", "record", "version", "quarter")
)


def _responses(t: Source):
    """Orders as responses with their lines, twice: the second time lines and tags stand the other way round, every fifth order's first line has one more, every eleventh order is missing."""
    q = F.col("l_quantity").cast("long")
    line = lambda more: F.struct(F.col("l_linenumber").alias("line"), (q + more).alias("quantity"), F.array(F.col("l_returnflag"), F.col("l_linestatus")).alias("tags"))
    changed = F.when((F.col("l_orderkey") % 5 == 0) & (F.col("l_linenumber") == 1), 1).otherwise(0)
    turned = F.struct(F.col("l_linenumber").alias("line"), (q + changed).alias("quantity"), F.array(F.col("l_linestatus"), F.col("l_returnflag")).alias("tags"))
    whole = lambda items, up: t.lineitem.groupBy(F.col("l_orderkey").alias("key")).agg(F.struct(F.sort_array(F.collect_list(items), up).alias("lines"), F.lit("CG:Old").alias("group")).alias("response"))
    return whole(line(0), True), whole(turned, False).where("key % 11 <> 0").withColumn("response", F.col("response").withField("group", F.lit("CGTERMS:New")))


_RENAMED = {"CG:Old": "CGTERMS:New"}
_TOUCHED = "SELECT DISTINCT l_orderkey AS key, o_orderpriority AS query FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
_MOVED = "EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = key AND key % 5 = 0 AND l_linenumber = 1)"
query("x37_discrepancies", f"SELECT query, count(*) AS n, count_if(key % 11 = 0 OR {_MOVED}) AS n_different FROM ({_TOUCHED}) GROUP BY query")(
    lambda t: responses.discrepancies(responses.response_states(*_responses(t), rewrites=_RENAMED), t.orders.select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("query")))
)
query("x37_leaf_differences", """WITH l AS (SELECT l_orderkey AS key, CAST(l_quantity AS BIGINT) AS q, CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END AS more FROM lineitem WHERE l_orderkey % 5 = 0 AND l_orderkey % 11 <> 0),
a AS (SELECT key, q, 1 AS o, 0 AS n FROM l UNION ALL SELECT key, q + more, 0, 1 FROM l)
SELECT key, 'lines[].quantity' AS path, concat('bigint:', q) AS value, CAST(sum(o) AS BIGINT) AS n_old, CAST(sum(n) AS BIGINT) AS n_new FROM a GROUP BY key, q HAVING sum(o) <> sum(n)""")(
    lambda t: responses.leaf_differences(*_responses(t), rewrites=_RENAMED)
)
