"""Queries: further joins, scalars, graph look-ups, builders, and streams over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import vocab
from ..operators import builders, filters, patterns
from ..sources import files, sinks
from ..streaming import streams
from .core import ALL, located, overlapping
from .registry import query
from .views import with_views

T = with_views("triples")

# ---- predicates and joins ----------------------------------------------------------------------------------------

query("f9_differ", T + " SELECT s, o FROM triples WHERE p = 'direction' AND o <> 'F'")(lambda t: patterns.scan(t.triples, "?s", "direction", "?o").where(F.col("o") != "F"))
query("f10_date_after", with_views("assertions") + " SELECT assertion FROM assertions WHERE '1997-06' < date_last_evaluated")(lambda t: t.assertions.where(filters.date_after("date_last_evaluated", "1997-06")).select("assertion"))
query("f11_date_range", with_views("assertions") + " SELECT assertion FROM assertions WHERE date_last_evaluated > '1995' AND date_last_evaluated < '1996-03'")(lambda t: t.assertions.where(filters.date_between("date_last_evaluated", "1995", "1996-03")).select("assertion"))
query("f12_regex", with_views("validity") + " SELECT stmt FROM validity WHERE regexp_matches(disease, '^(PRO|SM).*(MO|LL)$')")(lambda t: t.validity.where(filters.matches("disease", "^(PRO|SM).*(MO|LL)$")).select("stmt"))
query("f22_coding_variants", ALL + " SELECT DISTINCT variant FROM olap WHERE feature IN (SELECT feature FROM features WHERE protein_coding)")(lambda t: overlapping(t, located(t)[0].where("protein_coding")))
query("f23_no_nulls", with_views("assertions") + " SELECT assertion, date_last_evaluated FROM assertions WHERE date_last_evaluated IS NOT NULL")(lambda t: filters.no_nulls(t.assertions.select("assertion", "date_last_evaluated"), "date_last_evaluated"))
query("f24_raw_event_filter", "SELECT event_id FROM events WHERE regexp_matches(CAST(props AS VARCHAR), '[13579]\\}')")(lambda t: t.events.where(F.col("props").rlike("[13579]\\}")).select("event_id"))
query("j2_algebra_join", with_views("validity", "mechanism") + " SELECT v.gene, v.stmt, m.mech FROM (SELECT gene, stmt FROM validity WHERE moi = 'AD') v JOIN (SELECT feature AS gene, mech FROM mechanism WHERE mechanism = 'Haploinsufficiency') m ON v.gene = m.gene")(
    lambda t: patterns.join_shared(t.validity.where("moi = 'AD'").select("gene", "stmt"), t.mechanism.where("mechanism = 'Haploinsufficiency'").select(F.col("feature").alias("gene"), "mech"))
)
query("j5_correlated_anti", with_views("validity", "mechanism") + " SELECT v.stmt FROM validity v WHERE NOT EXISTS (SELECT 1 FROM mechanism m WHERE m.feature = v.gene AND m.strength = 'DosageSufficientEvidence')")(
    lambda t: patterns.not_exists(t.validity.select("gene", "stmt"), t.mechanism.where("strength = 'DosageSufficientEvidence'").select(F.col("feature").alias("gene"))).select("stmt")
)
query("j6_theta_self_join", with_views("validity") + " SELECT a.disease, a.stmt, b.stmt AS stmt_2 FROM validity a JOIN validity b ON a.disease = b.disease AND a.stmt <> b.stmt AND a.strength <> b.strength")(
    lambda t: patterns.theta_self_join(t.validity.select("disease", "stmt", "strength"), ["disease"], ["stmt", "strength"]).select("disease", "stmt", "stmt_2")
)
query("j13_full_outer_counts", "SELECT k, coalesce(a.n, 0) AS n_orders, coalesce(b.n, 0) AS n_lines FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY ALL) a FULL JOIN (SELECT l_partkey AS k, count(*) AS n FROM lineitem GROUP BY ALL) b USING (k)")(
    lambda t: t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n_orders")).join(t.lineitem.groupBy(F.col("l_partkey").alias("k")).agg(F.count("*").alias("n_lines")), "k", "full").na.fill(0, ["n_orders", "n_lines"])
)
query("j13_full_outer_orders", """SELECT coalesce(o.k, l.k) AS k, coalesce(n_orders, 0) AS n_orders, coalesce(n_lines, 0) AS n_lines
FROM (SELECT o_orderkey AS k, count(*) AS n_orders FROM orders GROUP BY k) o FULL JOIN (SELECT l_orderkey AS k, count(*) AS n_lines FROM lineitem GROUP BY k) l ON o.k = l.k""")(
    lambda t: t.orders.groupBy(F.col("o_orderkey").alias("k")).agg(F.count("*").alias("n_orders")).join(t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n_lines")), "k", "full").na.fill(0, ["n_orders", "n_lines"])
)
query("o7_triple_union", T + " SELECT s, p, o FROM triples WHERE p = 'memberOf' UNION SELECT s, p, o FROM triples WHERE p IN ('memberOf', 'direction')")(lambda t: filters.union_distinct(t.triples.where("p = 'memberOf'"), t.triples.where("p in ('memberOf', 'direction')")))

# ---- scalars -----------------------------------------------------------------------------------------------------

query("c11_refseq", "SELECT p_partkey, CASE WHEN p_partkey % 30 BETWEEN 1 AND 22 THEN lpad(CAST(p_partkey % 30 AS VARCHAR), 6, '0') END AS seq FROM part")(
    lambda t: t.part.select("p_partkey", F.nullif(F.regexp_extract(S.refseq(F.concat(F.lit("chr"), F.col("p_partkey") % 30), F.lit("hg19")), r"NC_(\d{6})", 1), F.lit("")).alias("seq"))
)
query("c13_gene_ids", with_views("features") + " SELECT feature, split_part(feature, ':', 2) AS gene_id FROM features")(lambda t: t.features.select("feature", S.gene_id(F.concat(F.lit("X:1,GeneID:"), F.split_part("feature", F.lit(":"), F.lit(2)), F.lit(",Y:2"))).alias("gene_id")))
query("c14_offset_instants", "SELECT o_orderkey, concat(CAST(CAST(o_orderdate AS DATE) AS VARCHAR), ' 13:55') AS instant FROM orders")(
    lambda t: t.orders.select("o_orderkey", F.date_format(S.offset_instant(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T09:55:41.000-0400"))), "yyyy-MM-dd HH:mm").alias("instant"))
)
query("c15_date_prefixes", with_views("assertions") + " SELECT assertion, substr(date_last_evaluated, 1, 4) AS year, substr(date_last_evaluated, 1, 10) AS day FROM assertions")(lambda t: t.assertions.select("assertion", S.date_part("date_last_evaluated", 4).alias("year"), S.date_part("date_last_evaluated").alias("day")))
query("c16_epoch_dates", "SELECT o_orderkey, strftime(make_timestamp(CAST(o_orderkey % 40000 AS BIGINT) * 43200000 * 1000), '%Y-%m-%d') AS day FROM orders")(lambda t: t.orders.select("o_orderkey", S.millis_date((F.col("o_orderkey") % 40000).cast("long") * 43200000).alias("day")))
query("c16_epoch_days", "SELECT o_orderkey, strftime(make_timestamp(CAST(o_orderkey % 20000 AS BIGINT) * 86400000 * 1000), '%Y-%m-%d') AS day FROM orders")(lambda t: t.orders.select("o_orderkey", S.millis_date((F.col("o_orderkey") % 20000).cast("long") * 86400000).alias("day")))
query("c26_label_fallback", T + " SELECT s, coalesce(max(CASE WHEN p = 'rdfs:label' THEN o END), max(CASE WHEN p = 'rdf:type' THEN o END), 'none') AS label FROM triples GROUP BY s")(
    lambda t: t.triples.groupBy("s").agg(*[F.max(F.when(F.col("p") == p, F.col("o"))).alias(c) for c, p in (("a", "rdfs:label"), ("b", "rdf:type"))]).select("s", S.first_of("a", "b", F.lit("none")).alias("label"))
)
query("c33_yes_no", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN true WHEN c_custkey % 3 = 1 THEN false END AS flag FROM customer")(
    lambda t: t.customer.select("c_custkey", S.yes_no(F.when(F.col("c_custkey") % 3 == 0, "Yes").when(F.col("c_custkey") % 3 == 1, "NO").otherwise("maybe")).alias("flag"))
)
query("c7_hpo", "SELECT c_custkey, concat('http://purl.obolibrary.org/obo/HP_', lpad(CAST(c_custkey AS VARCHAR), 7, '0')) AS iri FROM customer")(lambda t: t.customer.select("c_custkey", S.hpo_iri(F.concat(F.lit("Mode (HP:"), F.lpad(F.col("c_custkey").cast("string"), 7, "0"), F.lit(")"))).alias("iri")))
query("v1_dosage_levels", with_views("mechanism") + " SELECT mech, CASE strength WHEN 'DosageSufficientEvidence' THEN 'cg:DosageSufficientEvidence' WHEN 'DosageMinimalEvidence' THEN 'cg:DosageMinimalEvidence' ELSE 'cg:NoAssertion' END AS level FROM mechanism")(
    lambda t: t.mechanism.select("mech", vocab.lookup(vocab.DOSAGE_LEVEL, F.when(F.col("strength") == "DosageSufficientEvidence", "3").when(F.col("strength") == "DosageMinimalEvidence", "1"), "cg:NoAssertion").alias("level"))
)

# ---- look-ups ----------------------------------------------------------------------------------------------------

query("s21_prefix_scan", with_views("variants") + " SELECT variant, copy_change FROM variants WHERE starts_with(variant, 'var:12')")(lambda t: files.objects_with_prefix(t.variants.select("variant", "copy_change"), "var:12", "variant"))
query("s22_point_lookup", with_views("variants") + " SELECT variant, copy_change, seq_ref FROM variants WHERE variant = 'var:1'")(lambda t: files.object_by_iri(t.variants.select("variant", "copy_change", "seq_ref"), "var:1", "variant"))
query("g18_label_hops", T + """ SELECT a.s AS "order", c.o AS label FROM triples a LEFT JOIN triples b ON b.s = a.o AND b.p = 'memberOf' LEFT JOIN triples c ON c.s = b.o AND c.p = 'rdfs:label' WHERE a.p = 'subject'""")(
    lambda t: patterns.optional(patterns.optional(patterns.scan(t.triples, "?order", "subject", "?c"), patterns.scan(t.triples, "?c", "memberOf", "?n")), patterns.scan(t.triples, "?n", "rdfs:label", "?label")).select("order", "label")
)
query("g19_annotated_assertions", ALL + " SELECT assertion, classification FROM assertions WHERE assertion IN (SELECT subject FROM annotations)")(lambda t: t.assertions.join(t.annotations.select(F.col("subject").alias("assertion")), "assertion", "left_semi").select("assertion", "classification"))
query("g21_value_set_members", T + " SELECT o AS node, count(DISTINCT s) AS n FROM triples WHERE p = 'memberOf' GROUP BY o")(
    lambda t: patterns.values(t.triples.where("p = 'memberOf'").select(F.col("o").alias("node")).distinct(), t.triples, ["memberOf"], inverse=True).groupBy("node").agg(F.count("*").alias("n"))
)

# ---- builders over the tables ------------------------------------------------------------------------------------

query("b6_rows_to_triples", with_views("validity") + " SELECT stmt AS s, 'cg:gene' AS p, gene AS o, 'iri' AS o_kind FROM validity UNION SELECT stmt, 'dc:title', disease, 'literal' FROM validity UNION SELECT stmt, 'rdf:type', 'cg:Statement', 'iri' FROM validity")(
    lambda t: builders.to_triples(t.validity.select(F.col("stmt").alias("iri"), "gene", "disease"), "validity", kind="cg:Statement", literals=("disease",), names={"gene": "cg:gene", "disease": "dc:title"}).drop("g")
)
_ANNOTATED = {
    ("annotation", "rdf:type", "iri"): "'cg:AssertionAnnotation'", ("annotation", "cg:contributions", "iri"): "concat(annotation, 'contrib')", ("annotation", "cg:subject", "iri"): "subject",
    ("annotation", "dc:description", "literal"): "''", ("annotation", "cg:classification", "iri"): "CASE WHEN classification = 'NoAssessment' THEN 'cg:NoAssessment' ELSE classification END",
    ("concat(annotation, 'contrib')", "cg:agent", "iri"): "'me'", ("concat(annotation, 'contrib')", "cg:role", "iri"): "'cg:Author'", ("concat(annotation, 'contrib')", "cg:date", "literal"): "'2020'",
    ("annotation", "cg:evidence", "iri"): "concat('ev:', subject)",
}
query("b11_annotation_triples", with_views("annotations") + " UNION ALL ".join(f" SELECT annotation AS g, {s} AS s, '{p}' AS p, {o} AS o, '{k}' AS o_kind FROM annotations" for (s, p, k), o in _ANNOTATED.items()))(
    lambda t: builders.annotation_triples(
        t.annotations.select(F.col("annotation").alias("iri"), "subject", F.when(F.col("classification") != "NoAssessment", F.col("classification")).alias("classification"), F.lit(None).cast("string").alias("description"), F.lit("me").alias("agent"), F.lit("2020").alias("date"), F.array(F.concat(F.lit("ev:"), "subject")).alias("evidence"))
    )
)
query("b16_described_variants", "SELECT o_orderkey, CAST(o_orderkey AS BIGINT) AS start_outer, CAST(o_orderkey + 500 AS BIGINT) AS end_outer, CASE WHEN o_orderkey % 2 = 0 THEN 'efo:copy-number-loss' ELSE 'efo:copy-number-gain' END AS copy_change FROM orders WHERE o_orderkey % 30 BETWEEN 1 AND 22 AND o_orderkey % 11 <> 0")(
    lambda t: builders.build_variants(
        t.orders.select("o_orderkey", F.lit("hg19").alias("build"), F.concat(F.lit("chr"), F.col("o_orderkey") % 30).alias("chrom"), F.col("o_orderkey").cast("string").alias("start"), F.lit(None).cast("string").alias("start_min"), F.lit(None).cast("string").alias("start_max"),
                        F.when(F.col("o_orderkey") % 11 == 0, "x").otherwise((F.col("o_orderkey") + 500).cast("string")).alias("end"), F.lit(None).cast("string").alias("end_min"), F.lit(None).cast("string").alias("end_max"), F.when(F.col("o_orderkey") % 2 == 0, "DEL").otherwise("DUP").alias("svtype"))
    )[0].select("o_orderkey", "start_outer", "end_outer", "copy_change")
)
query("x12_rejected_variants", "SELECT o_orderkey, 'unknown variant type' AS reasons FROM orders WHERE o_orderkey % 5 = 0")(
    lambda t: builders.build_variants(t.orders.select("o_orderkey", F.lit("38").alias("build"), F.lit("X").alias("chrom"), F.lit("1").alias("start"), F.lit(None).cast("string").alias("start_min"), F.lit(None).cast("string").alias("start_max"), F.lit("9").alias("end"), F.lit(None).cast("string").alias("end_min"), F.lit(None).cast("string").alias("end_max"), F.when(F.col("o_orderkey") % 5 == 0, "INV").otherwise("DEL").alias("svtype")))[1].select("o_orderkey", F.array_join("reasons", ",").alias("reasons"))
)
query("k5_bed_rows", with_views("variants", "assertions") + " SELECT concat_ws(chr(9), seq_ref, start_outer, end_outer, variant, '500', '.', start_outer, end_outer, CASE direction WHEN 'Supports' THEN '255,0,0' WHEN 'Inconclusive' THEN '0,0,255' ELSE '0,255,0' END) AS value FROM variants JOIN assertions USING (variant)")(
    lambda t: sinks.bed_rows(t.variants.join(t.assertions.select("variant", F.concat(F.lit("cg:"), "direction").alias("direction")), "variant"), "seq_ref")
)

# ---- keyed tables and streams over the events table --------------------------------------------------------------

_KEYED = "key long, event_id long, event_type string, ts timestamp"


def _events(t):
    return t.events.select(F.col("user_id").cast("long").alias("key"), F.col("event_id").cast("long").alias("event_id"), "event_type", F.col("ts").cast("timestamp").alias("ts"))


def _replayed(t, fn_of_table):
    """The events in three batches dealt by a hash of their ids, so that older ones come late; the second batch is sent twice."""
    table = sinks.KeyedTable(t.spark, sinks.shared_folder(t.spark, "keyed"), _KEYED, order=("event_id",))
    fn = fn_of_table(table)
    e = _events(t)
    for i in range(3):
        for _ in range(2 if i == 1 else 1):
            fn(e.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == i), i)
    return table.read().select("key", "event_id", "event_type")


_LAST_EVENTS = (
    "SELECT CAST(user_id AS BIGINT) AS key, CAST(event_id AS BIGINT) AS event_id, event_type FROM events "
    "QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"
)
query("st2_last_write_wins", _LAST_EVENTS)(lambda t: _replayed(t, streams.last_write_wins))
query("st3_publish_or_delete", f"SELECT * FROM ({_LAST_EVENTS}) WHERE event_type <> 'error'")(
    lambda t: _replayed(t, lambda table: streams.publish_or_delete(table, F.col("event_type") != "error"))
)
