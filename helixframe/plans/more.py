"""Queries: scalars, predicates, patterns, lists, search and streams over the shared tables that the other modules leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import vocab
from ..operators import aggregates as A
from ..operators import builders, filters, intervals, patterns, reports, search
from ..sources import files, sinks
from ..streaming import streams
from .core import ALL, VF, located, model, overlaps
from .fixtures import K, event_log, pick, tabbed, text_file, text_of
from .registry import Source, query
from .views import with_views

# ---- scalars -----------------------------------------------------------------------------------------------------


def curie() -> Column:
    """A prefix in two cases, an unknown one or none."""
    return F.concat(pick(["mondo:", "HP:", "nowhere:", ""], F.col(K) % 4), F.col(K).cast("string"))


_IRI = "CASE p_partkey % 4 WHEN 0 THEN concat('http://purl.obolibrary.org/obo/MONDO_', p_partkey) WHEN 1 THEN concat('http://purl.obolibrary.org/obo/HP_', p_partkey) WHEN 2 THEN concat('nowhere:', p_partkey) ELSE CAST(p_partkey AS VARCHAR) END"
query("c2_keywords", "SELECT p_partkey, concat('http://purl.obolibrary.org/obo/MONDO_', p_partkey) AS iri, concat('mondo:', p_partkey) AS curie FROM part")(
    lambda t: t.part.select(K, S.keyword_to_iri(text_of(before=":mondo/")).alias("iri")).withColumn("curie", S.iri_to_curie("iri"))
)
query("c4_fields", f"SELECT p_partkey, {_IRI.replace('nowhere:', 'NOWHERE:')} AS iri FROM part")(lambda t: t.part.select(K, S.field_to_iri(F.concat(F.lit(" "), F.lower(curie()), F.lit(" "))).alias("iri")))
query("c5_rewritten_roots", "SELECT p_partkey, concat('https://identifiers.org/ncbigene:', p_partkey) AS iri FROM part")(lambda t: t.part.select(K, S.replace_root(text_of(before="https://www.ncbi.nlm.nih.gov/gene/"), "https://www.ncbi.nlm.nih.gov/gene/", vocab.PREFIXES["ncbigene"]).alias("iri")))
query("c8_digits", "SELECT p_partkey, CAST(regexp_replace(p_type || p_partkey || ',' || p_size, '\\D', '', 'g') AS BIGINT) AS n FROM part")(lambda t: t.part.select(K, S.digits(F.concat("p_type", F.col(K).cast("string"), F.lit(","), F.col("p_size").cast("string"))).alias("n")))
query("c19_longs", "SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_partkey AS BIGINT) END AS n FROM part")(lambda t: t.part.select(K, S.long_or_null(F.when(F.col(K) % 3 != 0, text_of()).otherwise("12x")).alias("n")))
query("c21_window_sizes", "SELECT o_orderkey, CAST(floor(o_custkey * 0.05 + 0.5) AS BIGINT) AS n FROM orders")(lambda t: t.orders.select("o_orderkey", S.round_half_up(F.col("o_custkey") * 0.05).alias("n")))
query("c22_sizes", with_views("features") + " SELECT feature, end_pos - start_pos AS size FROM features")(lambda t: t.features.select("feature", S.location_size("start_pos", "end_pos").alias("size")))
query("c23_content_ids", "SELECT count(DISTINCT concat(o_custkey, '|', o_orderstatus)) AS n_ids, count(*) AS n, true AS orderless FROM orders")(
    lambda t: t.orders.agg(F.countDistinct(S.content_id("T", a="o_custkey", b="o_orderstatus")).alias("n_ids"), F.count("*").alias("n"), F.bool_and(S.content_id("T", a="o_custkey", b="o_orderstatus") == S.content_id("T", b="o_orderstatus", a="o_custkey")).alias("orderless"))
)
query("c24_set_hashes", "SELECT count(DISTINCT s) AS n_sets FROM (SELECT list_sort(list_distinct(list(l_suppkey))) AS s FROM lineitem GROUP BY l_orderkey)")(
    lambda t: t.lineitem.groupBy("l_orderkey").agg(S.set_hash(F.collect_list("l_suppkey")).alias("h")).agg(F.countDistinct("h").alias("n_sets"))
)
query("c25_citations", "SELECT o_orderkey, concat(o_orderpriority, ', ', year(o_orderdate)) AS citation FROM orders")(lambda t: t.orders.select("o_orderkey", S.citation("o_orderpriority", F.date_format("o_orderdate", "yyyy MMM")).alias("citation")))
query("c27_descriptions", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN p_type ELSE '' END AS description FROM part")(
    lambda t: t.part.select(K, S.first_of(F.when(F.col(K) % 3 == 0, F.col("p_name")), F.when(F.col(K) % 3 == 1, F.col("p_type")), F.lit("")).alias("description"))
)
query("c29_without_spaces", "SELECT p_partkey, replace(p_name, ' ', '') AS iri FROM part")(lambda t: t.part.select(K, S.without_spaces("p_name").alias("iri")))
query("c30_cases", "SELECT p_partkey, upper(p_name) AS up, lower(p_type) AS down FROM part")(lambda t: t.part.select(K, F.upper("p_name").alias("up"), F.lower("p_type").alias("down")))
query("c34_paths", "SELECT event_id, coalesce(json_extract_string(props, '$.k'), '?') AS k, '?' AS missing FROM events")(
    lambda t: t.events.select("event_id", F.from_json("props", "k string, missing struct<deep: string>").alias("p")).select("event_id", S.path_or("p.k", "?").alias("k"), S.path_or("p.missing.deep", "?").alias("missing"))
)
query("c17_fixed_instants", "SELECT o_orderkey, '2020-01-02T03:04:05.000Z' AS at, true AS dated FROM orders")(
    lambda t: t.orders.select("o_orderkey", S.instant_text("2020-01-02T03:04:05.000Z").alias("at"), S.instant_text().rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{3}(Z|[+-]\d\d)$").alias("dated"))
)

# ---- predicates and patterns -------------------------------------------------------------------------------------

T = with_views("triples")
query("f3_projection", T + " SELECT DISTINCT o AS y FROM triples WHERE p = 'memberOf'")(lambda t: patterns.scan(t.triples, "?x", "memberOf", "?y").select("y").distinct())
query("f14_cnv", "SELECT l_orderkey AS k, l_linenumber AS n FROM lineitem WHERE l_linenumber % 2 = 0 AND (l_linenumber % 3 = 0 OR l_orderkey % 2000 > 1000)")(
    lambda t: t.lineitem.select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.when(F.col("l_linenumber") % 2 == 0, "Deletion").otherwise("Insertion").alias("variant_type"), F.when(F.col("l_linenumber") % 3 == 0, 1).alias("copy_count"),
        F.array(F.struct(F.lit(None).cast("long").alias("display_start"), F.lit(5).cast("long").alias("display_stop")), F.struct(F.lit(7).cast("long").alias("display_start"), (F.col("l_orderkey") % 2000 + 7).cast("long").alias("display_stop"))).alias("locations"),
    ).where(filters.is_cnv()).select("k", "n")
)
query("f15_valid_events", "SELECT event_id FROM events WHERE event_type IN ('view', 'click')")(lambda t: t.events.where(filters.valid_event("event_type", ("view", "click"))).select("event_id"))
query("f16_roles", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")(
    lambda t: t.orders.join(t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set(F.struct(F.col("l_returnflag").alias("role"))).alias("c")), "o_orderkey", "left").where(filters.has_role("c", "R")).select("o_orderkey")
)
query("f20_open_range", with_views("lof") + " SELECT gene FROM lof WHERE lower95 > 0.1 AND lower95 < 0.35")(lambda t: t.lof.where(filters.in_open_range("lower95", 0.1, 0.35)).select("gene"))
query("f21_recurrent_regions", "SELECT concat('r', p_partkey) AS region FROM part WHERE p_partkey % 5 = 0")(
    lambda t: builders.dosage_regions(t.part.select(text_of(before="r").alias("key"), F.create_map(F.lit("f"), F.lit("chr1:1-2")).alias("fields"), F.when(F.col(K) % 5 == 0, F.array(F.lit("Recurrent"))).alias("labels"), F.lit(None).cast("string").alias("gene")), {"grch37": "f"})
    .where("recurrent").select(F.replace("region", F.lit(vocab.PREFIXES["cgdosage"]), F.lit("")).alias("region"))
)
query("nf15_filter_use", with_views("annotations") + " SELECT classification, count(*) AS n, 'annotated, with the classification if one is given' AS description FROM annotations GROUP BY classification")(
    lambda t: t.annotations.groupBy("classification").agg(F.count("*").alias("n")).join(filters.list_filters(t.spark).where("filter = 'has_annotation'").select("description"))
)
query("j1_shared_variables", T + " SELECT a.s AS x, a.o AS y, b.o AS z FROM triples a JOIN triples b ON a.o = b.s AND b.p = 'memberOf' WHERE a.p = 'subject'")(
    lambda t: patterns.join_shared(patterns.scan(t.triples, "?x", "subject", "?y"), patterns.scan(t.triples, "?y", "memberOf", "?z")).select("x", "y", "z")
)
query("j4_semi_and_anti", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS ordered FROM customer")(
    lambda t: (lambda c, o: patterns.exists(c, o).withColumn("ordered", F.lit(True)).unionByName(patterns.not_exists(c, o).withColumn("ordered", F.lit(False))))(t.customer.select("c_custkey"), t.orders.select(F.col("o_custkey").alias("c_custkey")))
)
query("j8_interval_join", with_views("variants", "features") + " SELECT v.variant, f.feature FROM variants v JOIN features f ON v.seq_ref = f.seq_ref AND v.start_outer <= f.end_pos AND f.start_pos <= v.end_outer")(
    lambda t: (lambda fv: intervals.interval_join(fv[1], fv[0]).select(F.col("v_variant").alias("variant"), F.col("f_feature").alias("feature")))(located(t))
)


def two_builds(t: Source):
    """Locations of features and variants on two sequences each, so that a pair may meet twice, differently."""
    f, v = located(t)
    moved = lambda df, by: df.unionByName(df.withColumns({"seq_ref": F.concat("seq_ref", F.lit("b")), **{c: F.col(c) + by for c in ("start_outer", "start_inner", "end_inner", "end_outer")}}))
    return moved(v, 0), moved(f, 400)


query("a12_best_kind", with_views("variants", "features") + """, b AS (SELECT variant, seq_ref, start_outer, start_inner, end_inner, end_outer, is_range FROM variants UNION ALL SELECT variant, concat(seq_ref, 'b'), start_outer, start_inner, end_inner, end_outer, is_range FROM variants),
g AS (SELECT feature, ftype, seq_ref, start_pos, end_pos FROM features UNION ALL SELECT feature, ftype, concat(seq_ref, 'b'), start_pos + 400, end_pos + 400 FROM features),
k AS (SELECT v.variant, f.feature, CASE WHEN v.start_inner < f.start_pos AND f.end_pos < v.end_inner THEN 0 WHEN (v.start_inner < f.start_pos AND f.start_pos < v.end_inner) OR (f.end_pos < v.end_inner AND f.start_pos < f.end_pos) THEN 1 WHEN v.is_range THEN 2 ELSE 3 END AS r
  FROM b v JOIN g f ON v.seq_ref = f.seq_ref AND v.start_outer <= f.end_pos AND f.start_pos <= v.end_outer
  WHERE f.start_pos BETWEEN v.start_outer AND greatest(v.start_outer + CASE f.ftype WHEN 'Gene' THEN 500000 ELSE 12000000 END, v.end_outer) OR f.end_pos BETWEEN v.start_outer AND greatest(v.start_outer + CASE f.ftype WHEN 'Gene' THEN 500000 ELSE 12000000 END, v.end_outer))
SELECT variant, feature, CASE min(r) WHEN 0 THEN 'CompleteOverlap' WHEN 1 THEN 'PartialOverlap' ELSE 'OuterOverlap' END AS kind FROM k WHERE r < 3 GROUP BY variant, feature""")(lambda t: intervals.overlaps(*two_builds(t)))
query("l3_last_by_date", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 1")(lambda t: A.top(t.orders.select("o_orderkey", "o_orderdate"), 1, "o_orderdate", "o_orderkey"))
query("o4_union_of_locations", VF + " SELECT variant, string_agg(DISTINCT feature, ',' ORDER BY feature) AS features FROM olap WHERE kind = 'CompleteOverlap' GROUP BY variant")(
    lambda t: overlaps(t).where("kind = 'CompleteOverlap'").groupBy("variant").agg(F.array_join(F.sort_array(F.collect_set("feature")), ",").alias("features"))
)
query("o6_symmetric_difference", """WITH a AS (SELECT o_custkey AS k, list_sort(list_distinct(list(o_orderpriority))) AS x FROM orders WHERE o_orderstatus = 'F' GROUP BY k), b AS (SELECT o_custkey AS k, list_sort(list_distinct(list(o_orderpriority))) AS y FROM orders WHERE o_orderstatus = 'O' GROUP BY k)
SELECT k, array_to_string(list_sort(list_filter(x, lambda i: NOT list_contains(y, i))), ',') AS only_a, array_to_string(list_sort(list_filter(y, lambda i: NOT list_contains(x, i))), ',') AS only_b FROM a JOIN b USING (k)""")(
    lambda t: filters.set_differences(
        t.orders.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("k")).agg(F.collect_set("o_orderpriority").alias("x")).join(t.orders.where("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("k")).agg(F.collect_set("o_orderpriority").alias("y")), "k"), "x", "y",
    ).select("k", F.array_join("only_a", ",").alias("only_a"), F.array_join("only_b", ",").alias("only_b"))
)
query("x37_response_diff", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'only_new' WHEN o_orderkey % 5 = 0 THEN 'changed' ELSE 'same' END AS state FROM orders")(
    lambda t: (lambda o: filters.compare_snapshots(o.where("k % 7 <> 0"), o.withColumn("v", F.when(F.col("k") % 5 == 0, "x").otherwise(F.col("v"))), "k").select("k", "state"))(t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v")))
)
query("g1_property_path", T + " SELECT DISTINCT a.s AS node, c.o AS value FROM triples a JOIN triples b ON a.o = b.s AND b.p = 'memberOf' JOIN triples c ON b.o = c.s AND c.p = 'rdfs:label' WHERE a.p = 'subject'")(
    lambda t: patterns.bgp(t.triples, ("?node", "subject", "?a"), ("?a", "memberOf", "?b"), ("?b", "rdfs:label", "?value")).select("node", "value").distinct()
)
query("g2_alternatives", T + " SELECT DISTINCT s AS node, o AS value FROM triples WHERE p IN ('subject', 'memberOf')")(lambda t: patterns.values(t.triples.select(F.col("s").alias("node")).distinct(), t.triples, ["subject", "memberOf"]))

# ---- curation lists, feature levels, search ----------------------------------------------------------------------


def curated(t: Source) -> tuple[DataFrame, DataFrame]:
    """Curations (curation, gene, gene_label, disease, disease_label) and contributions (curation, agent, role)."""
    rows = t.validity.join(t.features.select(F.col("feature").alias("gene"), "symbol"), "gene")
    k = F.split_part("stmt", F.lit(":"), F.lit(2)).cast("long")
    curations = rows.select(F.col("stmt").alias("curation"), "gene", F.col("symbol").alias("gene_label"), "disease", F.lower("disease").alias("disease_label"))
    roles = rows.select(F.col("stmt").alias("curation"), F.concat(F.lit("agent:"), (k % 7).cast("string")).alias("agent"), F.when(k % 3 == 0, "APPROVER").otherwise("SECONDARY_CONTRIBUTOR").alias("role"))
    return curations, roles


_CURATED = with_views("validity", "features") + """, c AS (SELECT v.stmt AS curation, v.gene, f.symbol AS gene_label, v.disease, lower(v.disease) AS disease_label, CAST(split_part(v.stmt, ':', 2) AS BIGINT) AS k FROM validity v JOIN features f ON v.gene = f.feature) """
query("g14_approved_curations", _CURATED + "SELECT curation, gene_label, disease_label FROM c WHERE k % 3 = 0")(lambda t: reports.curation_list(*curated(t)).select("curation", "gene_label", "disease_label"))
query("g14_any_role_by_text", _CURATED + "SELECT curation FROM c WHERE contains(disease_label, 'romo')")(lambda t: reports.curation_list(*curated(t), role="ANY", text="ROMO").select("curation"))
query("g14_curated_diseases", _CURATED + "SELECT DISTINCT disease, disease_label FROM c")(lambda t: reports.curation_list(*curated(t), role="ANY", of="disease"))
query("g14_curated_genes", _CURATED + "SELECT DISTINCT gene, gene_label FROM c WHERE k % 3 <> 0")(lambda t: reports.curation_list(*curated(t), role="SECONDARY_CONTRIBUTOR", of="gene"))
query("g14_affiliations", _CURATED + "SELECT concat('agent:', k % 7) AS agent, count(*) AS n_curations, count_if(k % 3 = 0) AS n_approved, count_if(k % 3 <> 0) AS n_secondary FROM c GROUP BY ALL")(lambda t: reports.affiliation_counts(*curated(t)))
query("g14_affiliation_curations", _CURATED + "SELECT curation FROM c WHERE k % 3 = 0 AND k % 7 = 3")(lambda t: reports.curation_list(*curated(t), affiliation="agent:3").select("curation"))


def gene_models(t: Source) -> DataFrame:
    """Features of genes (orders), transcripts (their lines) and two exons for each, the second one shared by all lines."""
    k, n = F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")
    row = lambda kind, a, b, attrs: tabbed(F.lit("s"), F.lit("R"), F.lit(kind), a, b, F.lit("."), F.lit("+"), F.lit("."), attrs)
    own = F.concat(F.lit("ID=t"), k, F.lit("_"), n, F.lit(";Parent=g"), k)
    part = lambda e: F.concat(F.lit("ID=x"), k, F.lit("_"), n, F.lit(f"{e};Parent=t"), k, F.lit("_"), n, F.lit(";exon_id=E"), k, F.lit(f"_{e}"), n if e == "a" else F.lit(""))
    lines = t.lineitem.dropDuplicates(["l_orderkey", "l_linenumber"]).select(F.explode(F.array(
        row("mRNA", F.lit("1"), F.lit("9"), own), row("exon", n, F.concat(n, F.lit("0")), part("a")), row("exon", F.lit("100"), F.lit("200"), part("b")),
    )))
    genes = t.orders.select(row("gene", F.lit("1"), F.lit("999"), F.concat(F.lit("ID=g"), F.col("o_orderkey").cast("string"))))
    return files.load_gff(t.spark, text_file(lines.unionAll(genes), "models", gz=True), types=None)


_LINES = "WITH l AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)) "
query("x43_feature_levels", _LINES + "SELECT concat('g', k) AS gene, concat('t', k, '_', n) AS child, concat('x', k, '_', n, e) AS grandchild FROM l CROSS JOIN (VALUES ('a'), ('b')) v(e)")(lambda t: reports.feature_levels(gene_models(t)).select("gene", "child", "grandchild"))
query("x43_exon_ids", _LINES + "SELECT concat('g', k) AS gene, CAST(n AS BIGINT) AS start, CAST(concat(n, '0') AS BIGINT) AS \"end\", concat('E', k, '_a', n) AS exon_ids FROM l UNION ALL SELECT DISTINCT concat('g', k), 100, 200, concat('E', k, '_b') FROM l")(
    lambda t: reports.exon_ids(gene_models(t)).withColumn("exon_ids", F.array_join("exon_ids", ","))
)
query("x43_exon_sets", _LINES + "SELECT concat('g', k) AS gene, concat('t', k, '_', n) AS transcript, CAST(2 AS BIGINT) AS n_exons FROM l")(lambda t: reports.feature_hierarchy(gene_models(t)).select("gene", "transcript", "n_exons"))
query("t2_symbol_search", with_views("features") + " SELECT feature FROM features WHERE symbol = 'G11'")(lambda t: search.symbol_search(t.features, "g11").select("feature"))
def labels_with(t: Source, text: str) -> DataFrame:
    """Nodes whose label the text search finds, as a binding of a pattern's variable."""
    labels = patterns.scan(t.triples, "?nation", "rdfs:label", "?label")
    asked = t.spark.createDataFrame([("q", text)], "query string, text string")
    return search.bm25(labels, asked, "nation", "label", n=1_000_000).select("nation")


query("t6_embedded_texts", "SELECT doc_id, CAST(CASE WHEN length(coalesce(text, '')) = 0 THEN 0 ELSE 1 END AS DOUBLE) AS norm FROM documents")(
    lambda t: search.embed(t.documents, "doc_id", "text", character_counts).select("doc_id", F.round(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))), 3).alias("norm"))
)
query("t7_text_in_patterns", T + " SELECT a.s AS customer, a.o AS nation FROM triples a JOIN triples b ON b.s = a.o AND b.p = 'rdfs:label' WHERE a.p = 'memberOf' AND list_contains(regexp_split_to_array(lower(b.o), '[^a-z0-9]+'), '7')")(
    lambda t: patterns.scan(t.triples, "?customer", "memberOf", "?nation").join(labels_with(t, "7"), "nation", "left_semi").select("customer", "nation")
)
query("k6_log_records", with_views("annotations") + " SELECT annotation AS key, concat('{\"subject\":\"', subject, '\",\"classification\":\"', classification, '\"}') AS value FROM annotations")(
    lambda t: sinks.log_records(t.annotations, "annotation")
)
query("k8_search_documents", with_views("features") + " SELECT feature AS iri, 'features' AS source, symbol AS symbols, ftype AS types FROM features")(
    lambda t: search_table(t).read().select("iri", "source", F.array_join("symbols", ",").alias("symbols"), F.array_join("types", ",").alias("types"))
)
query("b18_search_documents", with_views("features") + " SELECT feature AS iri, 'features' AS source, symbol AS symbols, ftype AS types, '' AS labels FROM features")(
    lambda t: builders.search_documents(t.features, "features", "feature", symbols="symbol", types="ftype").select("iri", "source", *[F.array_join(c, ",").alias(c) for c in ("symbols", "types", "labels")])
)


def search_table(t: Source) -> sinks.KeyedTable:
    """Search documents upserted twice by iri."""
    table = sinks.KeyedTable(t.spark, sinks.shared_folder(t.spark, "search"), "iri string, source string, symbols array<string>, labels array<string>, types array<string>, descriptions array<string>", "iri")
    docs = builders.search_documents(t.features, "features", "feature", symbols="symbol", types="ftype")
    table.merge(upserts=docs.withColumn("source", F.lit("older")))
    table.merge(upserts=docs)
    return table


def character_counts(texts: list[str]):
    """A stand-in for an embedding model: counts of characters by code."""
    import numpy as np

    return np.stack([np.bincount(np.frombuffer(x.encode(), np.uint8) % 16, minlength=16) for x in texts])


query("b12_persons", "SELECT concat('https://curation.example.org/agent/', c_custkey) AS iri, c_name AS email, c_mktsegment AS given_name, 'x' AS family_name FROM customer")(
    lambda t: builders.persons(t.customer.select(F.lit("created").alias("event_type"), F.struct(text_of("c_custkey").alias("id"), F.col("c_name").alias("email"), F.col("c_mktsegment").alias("first_name"), F.lit("x").alias("last_name")).alias("person")))
)
query("b20_score_shape", with_views("lof") + " SELECT gene AS about, round(lower95, 6) AS score FROM lof WHERE lower95 > 0.2")(lambda t: t.lof.select(F.col("gene").alias("about"), F.round("lower95", 6).alias("score")).where(filters.in_open_range("score", 0.2, 2.0) & (F.col("score") > 0.2)))

# ---- streams -----------------------------------------------------------------------------------------------------

_EVENT = "key long, version string, ts long"


def batches_of(t: Source) -> list[DataFrame]:
    """The events as versions of their users' records, in three batches dealt by a hash of their ids: older versions come late."""
    e = t.events.select(F.col("user_id").cast("long").alias("key"), F.col("event_id").cast("string").alias("version"), F.col("event_id").cast("long").alias("ts"))
    return [e.where(F.pmod(F.xxhash64("ts"), F.lit(3)) == i) for i in range(3)]


def table_of(t: Source, schema: str = _EVENT, key: str = "key", order: tuple[str, ...] = ()) -> sinks.KeyedTable:
    return sinks.KeyedTable(t.spark, sinks.shared_folder(t.spark, "stream"), schema, key, buckets=8, order=order)


_HISTORY = "key long, version string, ts long, invalidated_by string"


def _superseded(t: Source) -> DataFrame:
    history = table_of(t, _HISTORY)
    fn = streams.supersede(table_of(t), history)
    for i, b in enumerate(batches_of(t)):
        fn(b, i)
    return history.read().withColumn("key", F.concat_ws("/", F.col("key").cast("string"), "version"))


_SENT = "SELECT CAST(user_id AS BIGINT) AS key, CAST(event_id AS BIGINT) AS e, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS next FROM events"
query("st5_superseded_versions", f"SELECT concat(key, '/', e) AS key, CAST(e AS VARCHAR) AS version, e AS ts, CAST(next AS VARCHAR) AS invalidated_by FROM ({_SENT}) WHERE next IS NOT NULL")(_superseded)


def _gated(t: Source) -> DataFrame:
    """The gate opens with the third batch; every event that waited is handed on."""
    history, gate = table_of(t, _HISTORY), {"open": False}
    fn = streams.gated(streams.supersede(table_of(t), history), lambda: gate["open"], table_of(t))
    for i, b in enumerate(batches_of(t)):
        gate["open"] = i == 2
        fn(b, i)
    return history.read().groupBy("key").agg(F.count("*").alias("n"))


query("st4_gated_events", f"SELECT key, count(*) AS n FROM ({_SENT}) WHERE next IS NOT NULL GROUP BY key")(_gated)


def _waited(t: Source) -> DataFrame:
    """Orders as events that wait for their customer; customers arrive in two parts, every seventh never."""
    spark, log = t.spark, sinks.shared_folder(t.spark, "log")
    orders = t.orders.select(F.col("o_orderkey").cast("long").alias("event"), F.col("o_custkey").cast("long").alias("gene"))
    customers = t.customer.select(F.col("c_custkey").cast("long").alias("gene")).where("gene % 7 <> 0")
    customers.where("gene % 2 = 0").write.parquet(f"{log}/genes/part=0")
    orders.write.parquet(f"{log}/events/part=0")
    out, progress = f"{log}/out", f"{log}/progress"
    spark.createDataFrame([], orders.schema).write.parquet(f"{out}/batch=-1")

    def run() -> None:
        read = lambda name, schema: spark.readStream.schema(schema).parquet(f"{log}/{name}/part=*")
        passed = streams.wait_for_key(read("events", orders.schema), read("genes", customers.schema), "gene")
        streams.start(passed, streams.batches_to(out), progress).awaitTermination()

    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store, None)
    streams.state_store(spark)
    try:
        run()
        customers.where("gene % 2 <> 0").write.parquet(f"{log}/genes/part=1")
        run()  # starts again from the checkpoint
    finally:
        spark.conf.unset(store) if before is None else spark.conf.set(store, before)
    return spark.read.schema(orders.schema).parquet(f"{out}/batch=*")


query("j14_events_after_their_gene", "SELECT CAST(o_orderkey AS BIGINT) AS event, CAST(o_custkey AS BIGINT) AS gene FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 7 <> 0")(_waited)


def _streamed(t: Source) -> DataFrame:
    """The event log as a stream, replayed to its end."""
    table = table_of(t, files.EVENTS, order=("ts", "topic", "value"))
    stream = files.read_event_log(t.spark, event_log(t), stream=True)
    streams.start(stream, streams.last_write_wins(table), sinks.shared_folder(t.spark, "progress")).awaitTermination()
    return table.read().select("key", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


query("st11_replayed_stream", "SELECT CAST(user_id AS VARCHAR) AS key, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS at FROM events GROUP BY user_id")(_streamed)
query("st1_topic_counts", "SELECT event_type AS topic, count(*) AS n FROM events GROUP BY event_type")(lambda t: files.read_event_log(t.spark, event_log(t)).groupBy("topic").agg(F.count("*").alias("n")))


def _region_events(t: Source) -> tuple[DataFrame, str]:
    v = located(t)[1]
    schema = "key string, status string, resolution string, resolutiondate string, ts long, seq_ref string, start_outer long, start_inner long, end_inner long, end_outer long, is_range boolean"
    k = F.split_part("variant", F.lit(":"), F.lit(2)).cast("long")
    events = v.select(F.col("variant").alias("key"), F.when(k % 3 == 0, "Open").otherwise("Closed").alias("status"), F.lit("Complete").alias("resolution"), F.lit("d").alias("resolutiondate"), F.lit(1).cast("long").alias("ts"), "seq_ref", "start_outer", "start_inner", "end_inner", "end_outer", "is_range")
    return events, schema


def _rejects_of(t: Source) -> sinks.KeyedTable:
    return table_of(t, "key string, status string, ts long", order=("ts",))


def _enriched(t: Source) -> DataFrame:
    events, schema = _region_events(t)
    found = table_of(t, "key string, feature string, kind string")
    streams.enrich_regions(located(t)[0], table_of(t, schema, order=("ts",)), found, _rejects_of(t), one_location=True)(events, 0)
    return found.read()


def _rejected(t: Source) -> DataFrame:
    """The rejects alone, by the function that the stream's enrichment calls for them."""
    rejects = _rejects_of(t)
    streams.reject_regions(rejects)(_region_events(t)[0], 0)
    return rejects.read().drop("ts")


query("st6_enriched_regions", VF + " SELECT variant AS key, feature, kind FROM olap WHERE protein_coding AND CAST(split_part(variant, ':', 2) AS BIGINT) % 3 <> 0")(_enriched)
query("st7_rejected_regions", "SELECT concat('var:', o_orderkey) AS key, 'Open' AS status FROM orders WHERE o_orderkey % 3 = 0")(_rejected)


def _marked(t: Source) -> DataFrame:
    progress = table_of(t, "name string, batch long", "name")
    fn = streams.with_marker(streams.last_write_wins(table_of(t, order=("ts",))), progress, "events")
    for i, b in enumerate(batches_of(t)):
        fn(b, i)
    return progress.read().join(t.events.agg(F.count("*").alias("n_events")))


query("st8_progress_marker", "SELECT 'events' AS name, CAST(2 AS BIGINT) AS batch, count(*) AS n_events FROM events")(_marked)


def _logged(t: Source) -> DataFrame:
    table = table_of(t, "start_time long, end_time long, duration long", "start_time", ("end_time",))
    streams.request_log(table)(t.orders.select(F.col("o_orderkey").cast("long").alias("start_time"), (F.col("o_orderkey") + F.col("o_custkey")).cast("long").alias("end_time")), 0)
    return table.read()


query("st9_request_log", "SELECT CAST(o_orderkey AS BIGINT) AS start_time, CAST(o_orderkey + o_custkey AS BIGINT) AS end_time, CAST(o_custkey AS BIGINT) AS duration FROM orders")(_logged)


def _people(t: Source) -> DataFrame:
    table = table_of(t, "iri string, email string, given_name string, family_name string, ts long", "iri", ("ts",))
    k = F.col("c_custkey")
    person = F.struct((k % 50).cast("string").alias("id"), F.col("c_name").alias("email"), F.lit("g").alias("first_name"), F.lit("f").alias("last_name"))
    streams.person_events(table)(t.customer.select(F.when(k % 2 == 0, "updated").otherwise("other").alias("event_type"), person.alias("person"), k.cast("long").alias("ts")), 0)
    return table.read().select("iri", "email")


query("st10_people", "SELECT concat('https://curation.example.org/agent/', c_custkey % 50) AS iri, max_by(c_name, c_custkey) AS email FROM customer WHERE c_custkey % 2 = 0 GROUP BY c_custkey % 50")(_people)
query("x22_filtered_base", ALL + " SELECT assertion FROM assertions WHERE direction = 'Supports' AND variant IN (SELECT variant FROM variants WHERE copy_change = 'loss')")(
    lambda t: filters.filter_bits(model(t), [("copy_change", "loss"), ("assertion_direction", "Supports")]).where("bits = 3").select("assertion")
)
