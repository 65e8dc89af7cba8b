"""Queries: aggregates, ranking, paging, sets, scalars, graphs, text and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import vocab
from ..operators import aggregates as A
from ..operators import filters, graph, intervals, search
from ..sources import sinks
from .core import ALL, located, overlaps
from .registry import SQL, query
from .views import with_views

YEAR = "year(o_orderdate)"

# ---- aggregates --------------------------------------------------------------------------------------------------

query("a1_frequencies", "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL")(lambda t: A.frequencies(t.orders, "o_orderpriority", "o_orderstatus"))
query("a2_gene_sets", with_views("gene_sets") + " SELECT assertion, string_agg(gene, ',' ORDER BY gene) AS genes FROM gene_sets GROUP BY assertion")(
    lambda t: t.gene_sets.groupBy("assertion").agg(F.array_join(F.sort_array(F.collect_set("gene")), ",").alias("genes"))
)
query("a4_distinct_counts", with_views("validity") + " SELECT count(DISTINCT gene) AS n_genes, count(DISTINCT disease) AS n_diseases, count(*) AS n FROM validity")(
    lambda t: t.validity.agg(F.countDistinct("gene").alias("n_genes"), F.countDistinct("disease").alias("n_diseases"), F.count("*").alias("n"))
)
query("a5_pair_groups", with_views("validity") + " SELECT count(*) AS n_pairs, CAST(sum(n) AS BIGINT) AS n_rows FROM (SELECT count(*) AS n FROM validity GROUP BY gene, disease)")(
    lambda t: A.frequencies(t.validity, "gene", "disease").agg(F.count("*").alias("n_pairs"), F.sum("n").alias("n_rows"))
)
query("a6_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 20")(lambda t: A.frequent(t.orders, 20, "o_custkey"))
query("a7_score_histogram", "SELECT c_mktsegment, string_agg(concat(s, '=', n), ' ' ORDER BY s) AS scores FROM (SELECT c_mktsegment, c_nationkey % 5 AS s, count(*) AS n FROM customer GROUP BY ALL) GROUP BY c_mktsegment")(
    lambda t: t.customer.groupBy("c_mktsegment", (F.col("c_nationkey") % 5).alias("s")).agg(F.count("*").alias("n")).groupBy("c_mktsegment")
    .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("s", "n"))), lambda x: F.concat(x["s"].cast("string"), F.lit("="), x["n"].cast("string"))), " ").alias("scores"))
)
query("a8_sum_of_counts", "SELECT CAST(sum(n) AS BIGINT) AS total FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)")(lambda t: A.frequencies(t.orders, "o_custkey").agg(F.sum("n").alias("total")))
query("a9_statistics", "SELECT c_mktsegment, round(avg(n), 6) AS mean, CAST(median(n) AS DOUBLE) AS median, min(n) AS least, max(n) AS most, count(*) AS n FROM (SELECT c_mktsegment, c_custkey, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) GROUP BY c_mktsegment")(
    lambda t: A.statistics(t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment", "c_custkey").agg(F.count("*").alias("k")), "k", "c_mktsegment")
)
query("a10_product", with_views("lof", "validity") + " SELECT disease, round(product(1 - lower95), 9) AS none FROM lof JOIN validity USING (gene) GROUP BY disease")(
    lambda t: t.lof.join(t.validity, "gene").groupBy("disease").agg(F.round(F.product(1 - F.col("lower95")), 9).alias("none"))
)
query("a11_longest_location", with_views("variants") + " SELECT copy_change, max(end_outer - start_outer) AS longest FROM variants GROUP BY copy_change")(
    lambda t: t.variants.groupBy("copy_change").agg(F.max(S.location_size("start_outer", "end_outer")).alias("longest"))
)
query("a13_report_pivot", with_views("assertions", "variants") + """ SELECT submitter, count_if(copy_change = 'loss' AND direction = 'Supports') AS "loss_Supports", count_if(copy_change = 'loss' AND direction = 'Refutes') AS "loss_Refutes",
count_if(copy_change = 'gain' AND direction = 'Supports') AS "gain_Supports", count_if(copy_change = 'gain' AND direction = 'Refutes') AS "gain_Refutes" FROM assertions JOIN variants USING (variant) GROUP BY submitter""")(
    lambda t: A.pivot_counts(t.assertions.join(t.variants, "variant").withColumn("cell", F.concat_ws("_", "copy_change", "direction")), ["submitter"], "cell", ["loss_Supports", "loss_Refutes", "gain_Supports", "gain_Refutes"])
)
query("a14_criteria_pivot", "SELECT o_custkey, " + ", ".join(f"count_if(o_orderpriority = '{p}') AS \"{p}\"" for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")) + " FROM orders GROUP BY o_custkey")(
    lambda t: A.pivot_counts(t.orders, ["o_custkey"], "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])
)
_YEARS = list(range(1992, 2000))
query("a15_points_per_year", f"SELECT o_orderpriority, {', '.join(f'CAST(coalesce(sum(o_custkey) FILTER ({YEAR} = {y}), 0) AS BIGINT) AS y{y}' for y in _YEARS)} FROM orders GROUP BY o_orderpriority")(
    lambda t: A.pivot_counts(t.orders.withColumn("y", F.concat(F.lit("y"), F.year("o_orderdate"))), ["o_orderpriority"], "y", [f"y{y}" for y in _YEARS], F.sum(F.col("o_custkey").cast("long")))
)
query("a16_conditional_counts", "SELECT o_custkey, count_if(o_orderstatus = 'F') AS n_new, count_if(o_orderstatus <> 'F' AND o_orderpriority = '1-URGENT') AS n_again FROM orders GROUP BY o_custkey")(
    lambda t: t.orders.groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("n_new"), F.count_if((F.col("o_orderstatus") != "F") & (F.col("o_orderpriority") == "1-URGENT")).alias("n_again"))
)
query("a17_year_by_class", with_views("assertions") + " SELECT substr(date_last_evaluated, 1, 4) AS year, classification, review_status, count(*) AS n FROM assertions GROUP BY ALL")(
    lambda t: A.frequencies(t.assertions.withColumn("year", S.date_part("date_last_evaluated", 4)), "year", "classification", "review_status")
)
query("a18_distinct_values", "SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders")(lambda t: t.orders.select("o_orderpriority", "o_orderstatus").distinct())
query("a19_duplicates", "SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")(lambda t: A.duplicates(t.lineitem, "l_partkey", "l_suppkey"))
query("a20_group_sizes", with_views("gene_sets") + " SELECT size, count(*) AS n FROM (SELECT assertion, count(*) AS size FROM gene_sets GROUP BY assertion) GROUP BY size")(lambda t: A.size_distribution(t.gene_sets, "assertion"))
query("a21_histogram", with_views("variants") + " SELECT copy_change, CAST(floor((end_outer - start_outer) / 5000) AS BIGINT) AS bin, count(*) AS n FROM variants GROUP BY ALL")(
    lambda t: A.histogram(t.variants.withColumn("size", F.col("end_outer") - F.col("start_outer")), "size", 5000, "copy_change")
)
query("a22_activity_flags", with_views("mechanism", "validity", "features") + """ SELECT f.feature AS gene, concat_ws(',', CASE WHEN f.feature IN (SELECT feature FROM mechanism WHERE strength <> 'DosageNoEvidence') THEN 'dosage' END, CASE WHEN f.feature IN (SELECT gene FROM validity) THEN 'validity' END) AS activities
FROM features f WHERE f.feature IN (SELECT feature FROM mechanism WHERE strength <> 'DosageNoEvidence') OR f.feature IN (SELECT gene FROM validity)""")(
    lambda t: t.mechanism.where("strength <> 'DosageNoEvidence'").select(F.col("feature").alias("gene"), F.lit("dosage").alias("a")).unionByName(t.validity.select("gene", F.lit("validity").alias("a")))
    .groupBy("gene").agg(F.array_join(F.sort_array(F.collect_set("a")), ",").alias("activities"))
)

# ---- ranking and paging ------------------------------------------------------------------------------------------

query("w1_running_total", "SELECT y, n, CAST(sum(n) OVER (ORDER BY y) AS BIGINT) AS total FROM (SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY ALL)")(
    lambda t: A.running_total(t.orders.groupBy(F.year("o_orderdate").cast("long").alias("y")).agg(F.count("*").alias("n")), "y")
)
query("w2_latest_event", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")(
    lambda t: A.latest(t.events.select("user_id", "event_id", "event_type", "ts"), "user_id", "ts", "event_id").drop("ts")
)
_VERSIONS = "SELECT conv_id, turn, role, concat(CAST(floor(turn / 3) AS BIGINT) + 1, '.', turn % 3) AS version FROM conversations"


def versions(t):
    return t.conversations.select("conv_id", "turn", "role", F.concat((F.floor(F.col("turn") / 3) + 1).cast("string"), F.lit("."), (F.col("turn") % 3).cast("string")).alias("version"))


query("w3_latest_of_major", f"SELECT conv_id, substr(version, 1, 1) AS major, max(version) AS version FROM ({_VERSIONS}) GROUP BY ALL")(lambda t: A.latest_of_major(versions(t).select("conv_id", "version").distinct(), "conv_id", "version"))
query("w4_best_classification", with_views("validity") + """ SELECT gene, stmt, strength, count(*) OVER (PARTITION BY gene) > 1 AS several FROM (SELECT concat('gene:', CAST(split_part(gene, ':', 2) AS BIGINT) % 50) AS gene, stmt, strength FROM validity)
QUALIFY row_number() OVER (PARTITION BY gene ORDER BY list_position(['Definitive', 'Strong', 'Moderate', 'Limited'], strength), stmt) = 1""")(
    lambda t: A.best_ranked(t.validity.select(F.concat(F.lit("gene:"), F.split_part("gene", F.lit(":"), F.lit(2)).cast("long") % 50).alias("gene"), "stmt", "strength"), "gene", "strength", vocab.STRENGTH_ORDER, "stmt")
)
query("w5_recent_contribution", "SELECT o_custkey, max(o_orderkey) FILTER (o_orderdate = d) AS o_orderkey FROM (SELECT *, max(o_orderdate) OVER (PARTITION BY o_custkey) AS d FROM orders) GROUP BY o_custkey")(
    lambda t: t.orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))
)
query("w6_role_priority", "SELECT o_custkey, coalesce(min(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END), min(CASE WHEN o_orderstatus = 'O' THEN o_orderkey END), min(o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")(
    lambda t: t.orders.groupBy("o_custkey").agg(*[F.min(F.when(F.col("o_orderstatus") == s, F.col("o_orderkey"))).alias(s) for s in "FO"], F.min("o_orderkey").alias("any")).select("o_custkey", F.coalesce("F", "O", "any").alias("o_orderkey"))
)
query("w7_earliest_year", "SELECT o_custkey, min(year(o_orderdate)) AS year FROM orders GROUP BY o_custkey")(lambda t: t.orders.groupBy("o_custkey").agg(F.min(F.year("o_orderdate").cast("long")).alias("year")))
query("w8_keep_last", "SELECT l_orderkey, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC) = 1")(
    lambda t: A.latest(t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber"), "l_orderkey", "l_linenumber", "l_partkey").drop("l_linenumber")
)
query("w9_version_list", f"SELECT conv_id, string_agg(concat(turn, ':', version, ':', role), ' ' ORDER BY turn, version, role) AS versions FROM ({_VERSIONS}) GROUP BY conv_id")(
    lambda t: A.version_list(versions(t), "conv_id", "turn", "version", "role").select("conv_id", F.array_join(F.transform("versions", lambda x: F.concat_ws(":", x["turn"].cast("string"), x["version"], x["role"])), " ").alias("versions"))
)
_CURATIONS = with_views("validity", "features") + ", c AS (SELECT stmt AS iri, symbol AS gene_label, disease AS disease_label, strength AS report_date FROM validity JOIN features ON gene = feature)"


def curations(t):
    return t.validity.join(t.features, F.col("gene") == F.col("feature")).select(F.col("stmt").alias("iri"), F.col("symbol").alias("gene_label"), F.col("disease").alias("disease_label"), F.col("strength").alias("report_date"))


query("l1_page", _CURATIONS + " SELECT * FROM c ORDER BY disease_label DESC, iri LIMIT 30 OFFSET 20")(lambda t: A.page(curations(t), 30, 20, "DISEASE_LABEL", True)[0])
query("l1_page_count", _CURATIONS + " SELECT count(*) AS count FROM c")(lambda t: A.page(curations(t), 30)[1])


def third_page(t):
    """The third page of thirty, each found from the last row of the one before."""
    after = None
    for _ in range(2):
        after = A.cursor(A.page_after(curations(t), 30, after, "DISEASE_LABEL", True), "DISEASE_LABEL")
    return A.page_after(curations(t), 30, after, "DISEASE_LABEL", True)


query("l1_keyset_page", _CURATIONS + " SELECT * FROM c ORDER BY disease_label DESC, iri LIMIT 30 OFFSET 60")(third_page)
query("l4_top_n", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 20")(lambda t: A.top(A.frequencies(t.orders, "o_custkey"), 20, "n", "o_custkey"))
query("l5_top_and_other", "SELECT k AS source, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN row_number() OVER (ORDER BY n DESC, source) <= 10 THEN source ELSE 'other' END AS k, n FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)) GROUP BY k")(
    lambda t: A.top_and_other(A.frequencies(t.documents, "source"), 10, "source")
)
query("l6_last_years", "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY ALL ORDER BY y DESC LIMIT 3")(lambda t: A.top(t.orders.groupBy(F.year("o_orderdate").cast("long").alias("y")).agg(F.count("*").alias("n")), 3, "y"))
query("l7_lowest_scores", with_views("lof") + " SELECT gene, lower95 FROM lof WHERE lower95 > 0.1 AND lower95 < 0.4 ORDER BY lower95, gene LIMIT 30")(lambda t: A.top(t.lof.where(filters.in_open_range("lower95", 0.1, 0.4)), 30, "lower95", "gene", ascending=True))

# ---- sets and snapshots ------------------------------------------------------------------------------------------

query("o1_union_distinct", with_views("mechanism", "validity") + " SELECT feature AS gene FROM mechanism UNION SELECT gene FROM validity")(lambda t: filters.union_distinct(t.mechanism.select(F.col("feature").alias("gene")), t.validity.select("gene")))
query("o2_bag_concat", with_views("mechanism", "validity") + " SELECT feature AS gene FROM mechanism UNION ALL SELECT gene FROM validity")(lambda t: t.mechanism.select(F.col("feature").alias("gene")).unionByName(t.validity.select("gene")))
query("o3_difference", with_views("mechanism", "validity") + " SELECT feature AS gene FROM mechanism EXCEPT SELECT gene FROM validity")(lambda t: filters.difference(t.mechanism.select(F.col("feature").alias("gene")), t.validity.select("gene"), "gene"))
_TWO = """, x AS (SELECT split_part(assertion, ':', 2) AS k, list(gene) AS a FROM gene_sets WHERE CAST(split_part(gene, ':', 2) AS BIGINT) % 3 <> 0 GROUP BY ALL), y AS (SELECT split_part(assertion, ':', 2) AS k, list(gene) AS b FROM gene_sets WHERE CAST(split_part(gene, ':', 2) AS BIGINT) % 5 <> 0 GROUP BY ALL)"""


def two_sets(t):
    n = F.split_part("gene", F.lit(":"), F.lit(2)).cast("long")
    k = F.split_part("assertion", F.lit(":"), F.lit(2)).alias("k")
    a = t.gene_sets.where(n % 3 != 0).groupBy(k).agg(F.collect_set("gene").alias("a"))
    return a.join(t.gene_sets.where(n % 5 != 0).groupBy(k).agg(F.collect_set("gene").alias("b")), "k")


query("o5_set_relations", with_views("gene_sets") + _TWO + """ SELECT k, len(list_filter(a, lambda v: NOT list_contains(b, v))) AS n_only_a, len(list_filter(b, lambda v: NOT list_contains(a, v))) AS n_only_b, len(list_filter(a, lambda v: list_contains(b, v))) AS n_both FROM x JOIN y USING (k)""")(
    lambda t: filters.set_differences(two_sets(t), "a", "b").select("k", *[F.size(c).cast("long").alias(f"n_{c}") for c in ("only_a", "only_b", "both")])
)
_SNAP = "SELECT o_orderkey AS k, o_orderstatus AS status, o_totalprice AS price FROM orders WHERE o_orderkey % 10 <> 0"


def snapshots(t):
    old = t.orders.where("o_orderkey % 10 <> 0").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    new = t.orders.where("o_orderkey % 10 <> 5").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")).alias("status"), F.col("o_totalprice").alias("price"))
    return filters.compare_snapshots(old, new, "k").withColumn("differs", F.array_join("differs", ","))


_DIFF = """SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'only_old' WHEN a.k IS NULL THEN 'only_new' WHEN a.status = b.status AND a.price = b.price THEN 'same' ELSE 'changed' END AS state,
CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL AND a.status <> b.status THEN 'status' ELSE '' END AS differs
FROM (SELECT o_orderkey AS k, o_orderstatus AS status, o_totalprice AS price FROM orders WHERE o_orderkey % 10 <> 0) a
FULL JOIN (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS status, o_totalprice AS price FROM orders WHERE o_orderkey % 10 <> 5) b ON a.k = b.k"""
query("o8_snapshot_diff", _DIFF)(snapshots)
query("x35_parity_summary", f"SELECT state, differs, count(*) AS n FROM ({_DIFF}) GROUP BY ALL")(lambda t: A.frequencies(snapshots(t), "state", "differs"))

# ---- scalars -----------------------------------------------------------------------------------------------------

_C1 = "concat('hgnc:', p_partkey)"
query("c1_curies", f"SELECT p_partkey, concat('https://identifiers.org/hgnc:', p_partkey) AS iri, {_C1} AS curie FROM part")(
    lambda t: t.part.select("p_partkey", S.curie_to_iri(F.concat(F.lit("hgnc:"), "p_partkey")).alias("iri")).withColumn("curie", S.iri_to_curie("iri"))
)
query("c3_hgnc_ids", "SELECT p_partkey, CASE WHEN p_partkey < 100000 THEN upper(id) ELSE id END AS id FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN concat('hgnc:', p_partkey) ELSE concat('', p_partkey) END AS id FROM part)")(
    lambda t: t.part.select("p_partkey", S.normal_hgnc(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("hgnc:"), "p_partkey")).otherwise(F.col("p_partkey").cast("string"))).alias("id"))
)
query("c6_id_tails", with_views("assertions") + " SELECT assertion, regexp_extract(assertion, '\\d+$') AS tail, nullif(regexp_extract(submitter, '[a-z]+'), '') AS kind FROM assertions")(
    lambda t: t.assertions.select("assertion", S.id_tail("assertion", r"\d+$").alias("tail"), S.id_tail("submitter", "[a-z]+").alias("kind"))
)
query("c9_locus", with_views("features") + " SELECT feature, seq_ref AS chrom, start_pos AS \"start\", end_pos AS \"end\" FROM features")(
    lambda t: t.features.select("feature", S.locus_parts(F.concat("seq_ref", F.lit(":"), "start_pos", F.lit("-"), "end_pos")).alias("l")).select("feature", "l.chrom", "l.start", "l.end")
)
query("c10_iscn", with_views("features") + " SELECT feature, 'hg19' AS build, '5' AS chrom, 'p15.2' AS band, start_pos AS \"start\", end_pos AS \"end\", 1 AS copies, 'mat' AS inheritance FROM features UNION ALL SELECT feature, NULL, 'X', 'q21', start_pos, end_pos, 3, 'pat' FROM features")(
    lambda t: t.features.select("feature", F.explode(S.iscn_variants(F.concat(F.lit("arr[hg19] 5p15.2("), F.format_number("start_pos", 0), F.lit("-"), F.format_number("end_pos", 0), F.lit(" )x1 mat, Xq21("), "start_pos", F.lit("_"), "end_pos", F.lit(")x3[0.4] pat")))).alias("v")).select("feature", "v.*")
)
query("c12_attributes", with_views("features") + " SELECT feature, CAST(end_pos AS VARCHAR) AS \"END\", ftype AS \"SVTYPE\", 'true' AS flag FROM features")(
    lambda t: t.features.select("feature", S.attributes(F.concat(F.lit("END="), "end_pos", F.lit(";SVTYPE="), "ftype", F.lit(";FLAG"))).alias("m")).select("feature", F.col("m")["END"].alias("END"), F.col("m")["SVTYPE"].alias("SVTYPE"), F.col("m")["FLAG"].alias("flag"))
)
query("c18_safe_parse", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN -1.0 ELSE p_retailprice END AS price, CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE CAST(p_partkey AS BIGINT) END AS n FROM part")(
    lambda t: t.part.select("p_partkey", S.double_or(F.when(F.col("p_partkey") % 3 == 0, "none").otherwise(F.col("p_retailprice").cast("string"))).alias("price"), S.long_or_null(F.when(F.col("p_partkey") % 2 == 0, "x").otherwise(F.col("p_partkey").cast("string"))).alias("n"))
)
query("c20_log_odds", with_views("lof") + " SELECT gene, round(ln((1 - lower95) / lower95), 6) AS odds FROM lof")(lambda t: t.lof.select("gene", F.round(S.log_odds("lower95"), 6).alias("odds")))
query("c28_gene_notes", with_views("gene_sets") + """ SELECT assertion, concat(CASE WHEN count(*) = 1 THEN 'the gene' ELSE 'the following genes:' END, ' ', array_to_string(list_slice(list(gene ORDER BY gene), 1, 10), ' ')) AS note FROM gene_sets GROUP BY assertion""")(
    lambda t: t.gene_sets.groupBy("assertion").agg(F.sort_array(F.collect_set("gene")).alias("g")).select("assertion", S.list_text("g", "the gene", "the following genes:").alias("note"))
)
query("c31_colours", with_views("assertions") + " SELECT assertion, CASE direction WHEN 'Supports' THEN '255,0,0' WHEN 'Inconclusive' THEN '0,0,255' WHEN 'Refutes' THEN '0,255,0' ELSE '100,100,100' END AS colour FROM assertions")(
    lambda t: t.assertions.select("assertion", S.colour(F.concat(F.lit("cg:"), "direction")).alias("colour"))
)
query("c32_extents", with_views("variants") + " SELECT variant, start_outer AS least, end_outer AS most FROM variants")(
    lambda t: t.variants.select("variant", S.extent("start_outer", "start_inner", "end_inner", "end_outer").alias("e")).select("variant", F.col("e.min").alias("least"), F.col("e.max").alias("most"))
)
query("c35_inner_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")(lambda t: t.events.select("event_id", S.inner_json("props", "k bigint")["k"].alias("k")))

# ---- graphs ------------------------------------------------------------------------------------------------------

E = with_views("edges") + """, closure AS (SELECT child AS node, parent AS ancestor, 1 AS depth FROM edges
UNION SELECT a.child, b.parent, 2 FROM edges a JOIN edges b ON a.parent = b.child
UNION SELECT a.child, c.parent, 3 FROM edges a JOIN edges b ON a.parent = b.child JOIN edges c ON b.parent = c.child)"""
query("g3_closure", E + " SELECT node, ancestor, depth FROM closure")(lambda t: graph.closure(t.edges))
_TYPES = ", types AS (SELECT s AS node, concat('nation:', split_part(o, ':', 2)) AS type FROM triples WHERE p = 'memberOf')"
_ET = with_views("edges", "triples") + E[len(with_views("edges")):] + _TYPES


def nation_types(t):
    return t.triples.where("p = 'memberOf'").select(F.col("s").alias("node"), F.col("o").alias("type"))


query("g4_mixed_path", _ET + """, r AS (SELECT node, ancestor AS reached FROM closure UNION SELECT child, child FROM edges UNION SELECT parent, parent FROM edges)
SELECT node, reached FROM r UNION SELECT r.node, t.s FROM r JOIN triples t ON t.p = 'subject' AND t.o = r.reached""")(lambda t: graph.path_with_inverse_end(t.edges, t.triples.where("p = 'subject'").select("s", "o")))
query("g5_inferred_types", _ET + " SELECT node, type FROM types UNION SELECT t.node, c.ancestor FROM types t JOIN closure c ON t.type = c.node")(lambda t: graph.inferred_types(nation_types(t), graph.closure(t.edges)))
query("g6_type_dispatch", _ET + """, i AS (SELECT node, type FROM types UNION SELECT t.node, c.ancestor FROM types t JOIN closure c ON t.type = c.node)
SELECT node, CASE min(CASE type WHEN 'nation:3' THEN 0 WHEN 'region:1' THEN 1 WHEN 'region:2' THEN 2 END) WHEN 0 THEN 'Three' WHEN 1 THEN 'First' WHEN 2 THEN 'Second' ELSE 'Other' END AS target FROM i GROUP BY node""")(
    lambda t: graph.dispatch(graph.inferred_types(nation_types(t), graph.closure(t.edges)), [("nation:3", "Three"), ("region:1", "First"), ("region:2", "Second")], "Other")
)
query("g7_instances", _ET + " SELECT DISTINCT node FROM types WHERE type = 'region:1' OR type IN (SELECT node FROM closure WHERE ancestor = 'region:1')")(lambda t: graph.instances_of(nation_types(t), t.edges, "region:1"))
query("g9_label_resolution", with_views("triples") + """ SELECT n.node, coalesce(l.o, (SELECT min_by(x.o, x.s) FROM triples m JOIN triples x ON m.o = x.s AND x.p = 'rdfs:label' WHERE m.p = 'memberOf' AND m.s = n.node)) AS label
FROM (SELECT DISTINCT s AS node FROM triples WHERE p IN ('memberOf', 'rdfs:label')) n LEFT JOIN triples l ON l.s = n.node AND l.p = 'rdfs:label'""")(
    lambda t: graph.resolve_label(t.triples.where("p in ('memberOf', 'rdfs:label')").select(F.col("s").alias("node")).distinct(), t.triples.where("p = 'rdfs:label'").select(F.col("s").alias("node"), F.col("o").alias("label")), t.triples.where("p = 'memberOf'").select(F.col("o").alias("s"), F.col("s").alias("o")))
)
query("g10_current_versions", f"SELECT concat(conv_id, '/', version) AS version, conv_id AS record FROM ({_VERSIONS}) WHERE role <> 'user'")(
    lambda t: graph.current_versions(versions(t).select(F.concat_ws("/", F.col("conv_id").cast("string"), "version").alias("version"), F.col("conv_id").alias("record"), "role").where("role <> 'user'").drop("role"), versions(t).where("role = 'user'").select(F.concat_ws("/", F.col("conv_id").cast("string"), "version").alias("version")))
)
query("g10_siblings", f"WITH v AS (SELECT DISTINCT concat(conv_id, '/', version) AS version, conv_id AS record FROM ({_VERSIONS})) SELECT a.version, b.version AS sibling FROM v a JOIN v b ON a.record = b.record AND a.version <> b.version")(
    lambda t: graph.siblings(versions(t).select(F.concat_ws("/", F.col("conv_id").cast("string"), "version").alias("version"), F.col("conv_id").alias("record")).distinct())
)
query("g11_evidence_tree", _ET + " SELECT DISTINCT node, ancestor AS evidence FROM closure WHERE ancestor <> 'world'")(lambda t: graph.evidence_tree(t.edges, nation_types(t), None, hide=t.edges.sparkSession.createDataFrame([("world",)], "evidence string")))
query("g11_evidence_of_roots", _ET + " SELECT DISTINCT node AS root, ancestor AS evidence FROM closure WHERE ancestor <> 'world' AND node IN (SELECT concat('customer:', c_custkey) FROM customer WHERE c_custkey % 50 = 0)")(
    lambda t: graph.evidence_of(t.edges, t.customer.where("c_custkey % 50 = 0").select(F.concat(F.lit("customer:"), "c_custkey").alias("root")), hide=t.edges.sparkSession.createDataFrame([("world",)], "evidence string"))
)
query("g13_reached_classes", _ET + " SELECT c.ancestor AS root, count(DISTINCT c.node) AS n, max(c.depth) AS depth FROM closure c WHERE c.ancestor LIKE 'region:%' GROUP BY ALL")(
    lambda t: graph.reachable(t.edges, t.region.select(F.concat(F.lit("region:"), "r_regionkey").alias("root")), source="parent", target="child", reflexive=False).groupBy("root").agg(F.count("*").alias("n"), F.max("depth").alias("depth"))
)
query("g17_feature_by_symbol", with_views("features") + " SELECT symbol, min(feature) AS feature FROM features WHERE symbol = 'G7' GROUP BY symbol")(lambda t: search.symbol_search(t.features, "g7").groupBy("symbol").agg(F.min("feature").alias("feature")))


def asserted_overlaps(t):
    """Assertions are joined to the variants' locations, not to the pairs, which then aren't shuffled."""
    f, v = located(t)
    about = t.assertions.select(F.col("variant").alias("_v"), "assertion")
    stated = v.join(about, v["variant"] == F.col("_v")).drop("_v").withColumn("stated", F.struct("variant", "assertion"))
    found = intervals.overlaps(stated, f, key="stated", one_location=True).where("kind = 'CompleteOverlap'")
    return found.select("feature", "stated.variant", "stated.assertion")


query("g20_feature_variants", ALL + " SELECT o.feature, o.variant, a.assertion FROM olap o JOIN assertions a ON a.variant = o.variant WHERE o.kind = 'CompleteOverlap'")(asserted_overlaps)

# ---- text and vectors --------------------------------------------------------------------------------------------

_BM = """WITH q AS (SELECT item_id AS query, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS qs FROM benchmark),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') AS ts FROM documents),
s AS (SELECT count(*) AS n_docs, avg(len(ts)) AS mean FROM d), asked AS (SELECT query, unnest(qs) AS term FROM q),
tf AS (SELECT doc_id, length, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS length, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
sc AS (SELECT query, doc_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / mean))), 6) AS score FROM tf JOIN df USING (term) JOIN asked USING (term) CROSS JOIN s GROUP BY ALL)
SELECT query, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS rank FROM sc) WHERE rank <= {n}"""
query("t1_text_search", _BM.format(n=100))(lambda t: search.bm25(t.documents, t.benchmark.select(F.col("item_id").alias("query"), "text"), "doc_id", "text", 100))
query("t1_text_hits", _BM.format(n=10).replace("SELECT query, doc_id, score, rank FROM", "SELECT query, round(max(score), 3) AS best, count(*) AS n FROM") + " GROUP BY query")(
    lambda t: search.bm25(t.documents, t.benchmark.select(F.col("item_id").alias("query"), "text"), "doc_id", "text", 10).groupBy("query").agg(F.round(F.max("score"), 3).alias("best"), F.count("*").alias("n"))
)
#: Items whose id is divisible by 50 are the queries.
_BM_ALL = _BM.replace("FROM benchmark)", "FROM benchmark WHERE item_id % 50 = 0)")
query("t1_text_search_all", _BM_ALL.format(n=100))(lambda t: search.bm25(t.documents, t.benchmark.where("item_id % 50 = 0").select(F.col("item_id").alias("query"), "text"), "doc_id", "text", 100))
query("t1_text_hits_all", _BM_ALL.format(n=10).replace("SELECT query, doc_id, score, rank FROM", "SELECT query, round(max(score), 3) AS best, count(*) AS n FROM") + " GROUP BY query")(
    lambda t: search.bm25(t.documents, t.benchmark.where("item_id % 50 = 0").select(F.col("item_id").alias("query"), "text"), "doc_id", "text", 10).groupBy("query").agg(F.round(F.max("score"), 3).alias("best"), F.count("*").alias("n"))
)
query("t3_typed_search", "SELECT doc_id FROM documents WHERE lang = 'en' AND list_contains(regexp_split_to_array(lower(text), '[^a-z0-9]+'), 'the')")(lambda t: t.documents.where((F.col("lang") == "en") & F.array_contains(search.terms("text"), "the")).select("doc_id"))
query("t4_combined_search", with_views("features") + " SELECT feature, 0 AS source_rank FROM features WHERE symbol = 'G7' UNION ALL SELECT feature, 1 FROM features WHERE contains(lower(symbol), '7')")(
    lambda t: search.combined(search.symbol_search(t.features, "g7").select("feature"), t.features.where(filters.mentions("symbol", "7")).select("feature"))
)
query("f18_mentions", "SELECT doc_id FROM documents WHERE contains(lower(coalesce(text, '')), 'idiot')")(lambda t: t.documents.where(filters.mentions("text", "Idiot")).select("doc_id"))
_NEAR = """WITH q AS (SELECT vec_id AS query, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS q FROM embeddings WHERE vec_id % 50 = 0), v AS (SELECT {group}, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
s AS (SELECT query, {group}, round(max(list_dot_product(e, q)), 6) AS score FROM v CROSS JOIN q GROUP BY ALL)
SELECT query, {group}, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, {group}) AS rank FROM s) WHERE rank <= 5"""


def _near(t, group: str, asked: str = "vec_id % 50 = 0"):
    return search.nearest(t.embeddings, t.embeddings.where(asked), "vec_id", "embedding", group, 5)


#: t5_nearest asks for every vector; the others ask for those whose id is divisible by 50.
query("t5_nearest", _NEAR.format(group="label").replace(" WHERE vec_id % 50 = 0", ""))(lambda t: _near(t, "label", "true"))
for _name, _group in (("t5_nearest_all", "label"), ("t5_nearest_vectors", "vec_id")):
    query(_name, _NEAR.format(group=_group))(lambda t, g=_group: _near(t, g))


def indexed(t):
    """Documents in an index after three batches: two thirds come, then the last third and every fifth one anew, then every seventh goes."""
    index = search.TextIndex(t.spark, sinks.shared_folder(t.spark, "index"))
    d, k = t.documents.select("doc_id", "text"), F.col("doc_id")
    old = F.when(k % 5 == 0, F.lit("words that a later batch takes back")).otherwise(F.col("text"))
    index.apply(0, d.where(k % 3 != 2).withColumn("text", old))
    for _ in range(2):  # sent twice
        index.apply(1, d.where((k % 3 == 2) | (k % 5 == 0)))
    index.apply(2, deletes=d.where(k % 7 == 0).select("doc_id"))
    return index


_INDEXED = _BM.format(n=100).replace("FROM documents)", "FROM documents WHERE doc_id % 7 <> 0)").replace("FROM benchmark)", "FROM benchmark WHERE item_id % 50 = 0)")
query("t1_maintained_index", _INDEXED)(lambda t: indexed(t).bm25(t.benchmark.where("item_id % 50 = 0").select(F.col("item_id").alias("query"), "text")))
