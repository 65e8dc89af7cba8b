"""Curation reports and dashboards as table functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import vocab
from .aggregates import frequencies, pivot_counts, running_total
from .filters import MODERATE_OR_MORE, Model, apply_filters, filter_bits, mentions

Call = tuple[str, str | None, str]

_YES, _NO = "exists", "not_exists"
_PROPOSITION: Call = ("proposition_type", "VariantPathogenicityProposition", _YES)
_LOSS: list[Call] = [_PROPOSITION, ("copy_change", "loss", _YES)]
_GAIN: list[Call] = [_PROPOSITION, ("copy_change", "gain", _YES)]
_FEW: Call = ("gene_count_min", "Genes35", _NO)


def _complete(features: str, op: str = _YES) -> Call:
    return ("complete_overlap_with_feature_set", features, op)


def _partial(features: str, op: str = _YES) -> Call:
    return ("partial_overlap_with_feature_set", features, op)


_HAPLO, _ADXL, _AR = "HaploinsufficiencyFeatures", "GeneValidityModerateAndGreaterADXL", "ARGene"

#: The case mix (X21): eleven named combinations of filter calls; the later ones for losses exclude what the earlier ones explain.
COMBINATIONS: dict[str, list[Call]] = {
    "losses_of_35_genes": [*_LOSS, ("gene_count_min", "Genes35", _YES)],
    "gains_of_50_genes": [*_GAIN, ("gene_count_min", "Genes50", _YES)],
    "losses_complete_haploinsufficient": [*_LOSS, _complete(_HAPLO)],
    "gains_complete_triplosensitive": [*_GAIN, _complete("TriplosensitivityFeatures")],
    "losses_complete_adxl": [*_LOSS, _complete(_ADXL)],
    "losses_complete_recessive_alone": [*_LOSS, _complete(_AR), _complete(_ADXL, _NO), _complete(_HAPLO, _NO), _FEW],
    "losses_partial_haploinsufficient": [*_LOSS, _partial(_HAPLO), _complete(_HAPLO, _NO), _FEW],
    "losses_partial_adxl": [*_LOSS, _partial(_ADXL), _partial(_HAPLO, _NO), _complete(_HAPLO, _NO), _FEW],
    "losses_partial_recessive": [*_LOSS, _partial(_AR), _partial(_ADXL, _NO), _complete(_ADXL, _NO), _partial(_HAPLO, _NO), _complete(_HAPLO, _NO), _FEW],
    "losses_without_curated_features": [*_LOSS, *[f(s, _NO) for s in (_AR, _ADXL, _HAPLO) for f in (_partial, _complete)], _FEW],
    "annotated": [_PROPOSITION, ("has_annotation", None, _YES)],
}

#: The candidate gold standard (X22): losses called pathogenic that the dosage map doesn't explain. Submitter and date are the given tables'.
GOLD_STANDARD: list[Call] = [
    *_LOSS, _partial(_HAPLO, _NO), _complete(_HAPLO, _NO), _FEW, ("assertion_direction", "Supports", _YES), ("submitter", "agent:1", _NO), ("date_evaluated_min", "1996", _YES), _complete("ProteinCodingGenes"),
]

#: Single filters and pairs of them.
SIMPLE_COMBINATIONS: dict[str, list[Call]] = {
    "supported_losses": [("copy_change", "loss", "exists"), ("assertion_direction", "Supports", "exists")],
    "supported_gains": [("copy_change", "gain", "exists"), ("assertion_direction", "Supports", "exists")],
    "losses_over_haploinsufficient": [("copy_change", "loss", "exists"), ("complete_overlap_with_feature_set", "HaploinsufficiencyFeatures", "exists")],
    "gains_over_triplosensitive": [("copy_change", "gain", "exists"), ("complete_overlap_with_feature_set", "TriplosensitivityFeatures", "exists")],
    "losses_without_haploinsufficient": [("copy_change", "loss", "exists"), ("complete_overlap_with_feature_set", "HaploinsufficiencyFeatures", "not_exists")],
    "partial_over_haploinsufficient": [("copy_change", "loss", "exists"), ("partial_overlap_with_feature_set", "HaploinsufficiencyFeatures", "exists")],
    "losses_over_moderate_adxl": [("copy_change", "loss", "exists"), ("complete_overlap_with_feature_set", "GeneValidityModerateAndGreaterADXL", "exists")],
    "losses_over_recessive": [("copy_change", "loss", "exists"), ("complete_overlap_with_feature_set", "ARGene", "exists")],
    "no_coding_gene": [("complete_overlap_with_feature_set", "ProteinCodingGenes", "not_exists"), ("partial_overlap_with_feature_set", "ProteinCodingGenes", "not_exists")],
    "recent": [("date_evaluated_min", "1997", "exists")],
    "annotated": [("has_annotation", None, "exists")],
    "gold_standard": [("copy_change", "loss", "exists"), ("assertion_direction", "Supports", "exists"), ("complete_overlap_with_feature_set", "HaploinsufficiencyFeatures", "exists"), ("date_evaluated_min", "1995", "exists"), ("has_annotation", None, "not_exists"), ("is_obsolete", None, "not_exists")],
}


def combination(m: Model, calls: list[Call]) -> DataFrame:
    """(assertion): those that meet all calls, by one interval join and one aggregation."""
    distinct = list(dict.fromkeys((f, a) for f, a, _ in calls))
    want = sum(1 << i for i, c in enumerate(distinct) if (*c, _YES) in calls)
    return filter_bits(m, distinct).where(F.col("bits") == want).select("assertion")


def case_mix(m: Model, combinations: dict[str, list] = COMBINATIONS) -> DataFrame:
    """(combination, classification, n): the class distribution of each combination."""
    distinct = list(dict.fromkeys((f, a) for calls in combinations.values() for f, a, _ in calls))
    bit = lambda f, a: F.col("bits").bitwiseAND(F.lit(1 << distinct.index((f, a)))) != 0
    kept = []
    for name, calls in combinations.items():
        holds = F.lit(True)
        for f, a, op in calls:
            holds = holds | bit(f, a) if op == "union" else holds & (bit(f, a) if op == "exists" else ~bit(f, a))
        kept.append(F.when(holds, F.lit(name)))
    rows = filter_bits(m, distinct).select("classification", F.explode(F.array_compact(F.array(*kept))).alias("combination"))
    return rows.groupBy("combination", "classification").agg(F.count("*").alias("n"))


def about_feature(links: list[DataFrame], invalidated: DataFrame) -> DataFrame:
    """Assertions about features by any of the given (feature, assertion) links, without invalidated ones."""
    out = links[0].select("feature", "assertion")
    for x in links[1:]:
        out = out.unionByName(x.select("feature", "assertion"))
    return out.distinct().join(invalidated, "assertion", "left_anti").select("feature", "assertion")


def region_report(matches: DataFrame, facts: DataFrame) -> DataFrame:
    """Per region, counts of matching variants by copy change and direction; 0 where there are none (X19). facts: (variant, copy_change, direction)."""
    cells = [f"{c}_{d}" for c in ("loss", "gain") for d in ("Supports", "Inconclusive", "Refutes")]
    return pivot_counts(matches.join(facts, "variant").withColumn("cell", F.concat_ws("_", "copy_change", "direction")), ["region"], "cell", cells)


def submission_rows(annotated: DataFrame, reason: str, day: str, map_name: str = "dosage map") -> tuple[DataFrame, DataFrame]:
    """Flagging submissions and rejects (X23). annotated: assertion, version, variant, vcv, vcv_version, submitter, genes (array)."""
    rows = annotated.withColumns({"scv": S.id_tail("assertion", r"SCV\d+$"), "variation": S.id_tail("variant", r"\d+$"), "submitter_id": S.id_tail("submitter", r"\d+$")})
    bad = F.array_compact(F.array(F.when(F.col("scv").isNull(), "no submission id"), F.when(F.col("variation").isNull(), "no variation id"), F.when(F.col("submitter_id").isNull(), "no submitter id"), F.when(F.col("vcv").isNull(), "no record")))
    rows = rows.withColumn("reasons", bad)
    notes = F.concat(F.lit(f"This submission was flagged because its interpretation of this variant conflicts with the {map_name} "), F.when(F.size("genes") > 1, "curations ").otherwise("curation "), F.lit("for "), S.list_text("genes", "the gene", "the following genes:"), F.lit("."))
    good = rows.where("size(reasons) = 0").select(
        F.lit(day).alias("date_created"), F.concat_ws(".", "vcv", "vcv_version").alias("vcv"), F.concat_ws(".", "scv", "version").alias("scv"), F.col("variation").alias("variation_id"),
        "submitter_id", F.lit("flagging candidate").alias("action"), F.lit(reason).alias("reason"), notes.alias("notes"),
    )
    return good, rows.where("size(reasons) > 0").select("assertion", "reasons")


def leaderboard(annotations: DataFrame, assertions: DataFrame) -> DataFrame:
    """Annotated assertions per submitter, most first."""
    hit = assertions.join(annotations.select(F.col("subject").alias("assertion")).distinct(), "assertion", "left_semi")
    return frequencies(hit, "submitter")


def annotated_conflicts(annotations: DataFrame, assertions: DataFrame, found: DataFrame, features: DataFrame) -> DataFrame:
    """Annotated assertions with the symbols of the features their variants cover, joined."""
    names = found.where("kind = 'CompleteOverlap'").join(features.select("feature", "symbol"), "feature").groupBy("variant").agg(F.array_join(F.sort_array(F.collect_set("symbol")), " ").alias("genes"))
    return annotations.join(assertions, F.col("subject") == F.col("assertion")).drop(assertions["classification"]).join(names, "variant", "left").select("annotation", "assertion", "classification", F.coalesce("genes", F.lit("")).alias("genes"))


def recuration(versions: DataFrame, reasons: dict[str, list[str]]) -> DataFrame:
    """Per affiliation, new curations and recurations; a version whose reasons name both counts as new (X28). versions: affiliation, reasons (array)."""
    new = F.arrays_overlap("reasons", F.array(*map(F.lit, reasons["new"])))
    again = F.arrays_overlap("reasons", F.array(*map(F.lit, reasons["again"]))) & ~new
    return versions.groupBy("affiliation").agg(F.count_if(new).alias("n_new"), F.count_if(again).alias("n_again"))


def points_by_paper(points: DataFrame, totals: DataFrame) -> DataFrame:
    """Per curation: total, sum over papers, their difference."""
    papers = points.groupBy("curation").agg(F.sum("points").alias("papers"))
    return totals.join(papers, "curation", "left").select("curation", "total", F.coalesce("papers", F.lit(0)).alias("papers"), F.round(F.col("total") - F.coalesce("papers", F.lit(0)), 6).alias("difference"))


def quarterly(approvals: DataFrame, secondary: DataFrame) -> DataFrame:
    """Counts per quarter and group of both kinds, full outer; 0 where one side has none."""
    a, b = frequencies(approvals, "quarter", "agent").withColumnRenamed("n", "approvals"), frequencies(secondary, "quarter", "agent").withColumnRenamed("n", "secondary")
    return a.join(b, ["quarter", "agent"], "full").na.fill(0, ["approvals", "secondary"])


def counted_versions(versions: DataFrame, quarter: Column, record: str = "record", version: str = "version", date: str = "date") -> DataFrame:
    """versions with the quarter of their date: those whose number ends with .0, and those whose record has such a version in the same quarter.

    The records' first versions are found per quarter in one aggregation, so no version is joined to another of its record.
    """
    rows = versions.withColumn("quarter", quarter).where(F.col(date).isNotNull())
    first = F.coalesce(F.rlike(version, F.lit(r"\.0$")), F.lit(False))
    with_first = rows.where(first).select(record, "quarter").distinct()
    return rows.where(first).unionByName(rows.where(~first).join(with_first, [record, "quarter"], "left_semi"))


def quarterly_productivity(versions: DataFrame, roles: DataFrame, quarter: Column, key: str = "curation") -> DataFrame:
    """(quarter, agent, approvals, secondary): how many counted versions each agent approved or contributed to second.

    versions: (curation, record, version, date); roles: (curation, role, agent). A version's approver is the first by name,
    as is its secondary contributor; agents without a name are left out.
    """
    counted = counted_versions(versions, quarter).select(key, "quarter")
    first = lambda role: roles.where(F.col("role") == role).groupBy(key).agg(F.min("agent").alias("agent")).where("agent is not null")
    return quarterly(counted.join(first("Approver"), key), counted.join(first("SecondaryContributor"), key))


def gene_report(features: DataFrame, validity: DataFrame, mechanism: DataFrame, criteria: DataFrame) -> DataFrame:
    """Per gene: best validity, dosage strengths and number of variants per count."""
    v = validity.groupBy(F.col("gene").alias("feature")).agg(F.min(F.struct(F.array_position(F.array(*map(F.lit, vocab.STRENGTH_ORDER)), F.col("strength")).alias("r"), "strength"))["strength"].alias("validity"))
    d = mechanism.groupBy("feature").pivot("mechanism", ["Haploinsufficiency", "Triplosensitivity"]).agg(F.min("strength"))
    return features.select("feature", "symbol").join(v, "feature", "left").join(d, "feature", "left").join(criteria, "feature", "left").fillna(0, ["n_complete", "n_partial"])


def dominant_mentions(validity: DataFrame, scores: DataFrame, text: str, column: str = "disease") -> DataFrame:
    """(stmt, gene, score): dominant statements of moderate strength or more whose text mentions something, in any case, with their gene's score, 0 if there is none (X26). scores: (gene, score)."""
    said = validity.where(F.col("strength").isin(*MODERATE_OR_MORE) & (F.col("moi") == "AD") & mentions(column, text))
    return said.join(scores, "gene", "left").select("stmt", "gene", F.coalesce("score", F.lit(0.0)).alias("score"))


def dosage_candidates(validity: DataFrame, mechanism: DataFrame) -> DataFrame:
    """Genes of moderate or better validity without a mechanism proposition."""
    strong = validity.where("strength in ('Moderate', 'Strong', 'Definitive')")
    return strong.join(mechanism.select(F.col("feature").alias("gene")), "gene", "left_anti")


def request_statistics(log: DataFrame, duration: str = "duration", status: str = "status", size: str = "size") -> DataFrame:
    """Per status: requests, mean and longest duration."""
    return log.groupBy(status).agg(F.count("*").alias("n"), F.round(F.avg(duration), 6).alias("mean"), F.max(duration).alias("longest"))


def yearly(df: DataFrame, date: str) -> DataFrame:
    """Counts per year with running totals."""
    return running_total(df.where(F.col(date).isNotNull()).groupBy(S.date_part(date, 4).alias("year")).agg(F.count("*").alias("n")), "year")


def differing_regions(a: DataFrame, b: DataFrame, compat: bool = False) -> DataFrame:
    """Regions whose coding genes differ between two builds (X40). Sides: (region, gene). compat: only where the counts differ."""
    left = a.groupBy("region").agg(F.collect_set("gene").alias("x"))
    right = b.groupBy("region").agg(F.collect_set("gene").alias("y"))
    empty = F.array().cast("array<string>")
    both = left.join(right, "region", "full").withColumns({"x": F.coalesce("x", empty), "y": F.coalesce("y", empty)})
    both = both.withColumns({"only_a": F.sort_array(F.array_except("x", "y")), "only_b": F.sort_array(F.array_except("y", "x"))})
    differ: Column = F.size("x") != F.size("y") if compat else (F.size("only_a") > 0) | (F.size("only_b") > 0)
    return both.where(differ).select("region", "only_a", "only_b")


def feature_hierarchy(gff: DataFrame) -> DataFrame:
    """Per transcript (child of a gene): its gene, number of exons and order-free hash of its exon set."""
    genes = gff.where("type = 'gene'").select(F.col("id").alias("gene"))
    children = gff.select(F.col("id").alias("transcript"), F.col("parent").alias("gene")).join(genes, "gene")
    exons = gff.where("type = 'exon'").select(F.col("parent").alias("transcript"), "hash")
    return children.join(exons, "transcript").groupBy("gene", "transcript").agg(F.count("*").alias("n_exons"), S.set_hash(F.collect_set("hash")).alias("exon_set"))


def feature_levels(gff: DataFrame) -> DataFrame:
    """(gene, child, child_type, grandchild, grandchild_type): features two levels below a gene by Parent and ID; a child without children has null ones."""
    below = gff.where("parent is not null").select("id", F.col("parent"), "type")
    child = below.select(F.col("parent").alias("gene"), F.col("id").alias("child"), F.col("type").alias("child_type"))
    grandchild = below.select(F.col("parent").alias("child"), F.col("id").alias("grandchild"), F.col("type").alias("grandchild_type"))
    return gff.where("type = 'gene'").select(F.col("id").alias("gene")).join(child, "gene").join(grandchild, "child", "left").select("gene", "child", "child_type", "grandchild", "grandchild_type")


def exon_ids(gff: DataFrame) -> DataFrame:
    """(gene, start, end, exon_ids): the exon ids that a gene's transcripts use for each place."""
    genes = gff.where("type = 'gene'").select(F.col("id").alias("gene"))
    children = gff.select(F.col("id").alias("transcript"), F.col("parent").alias("gene")).join(genes, "gene")
    exons = gff.where("type = 'exon'").select(F.col("parent").alias("transcript"), "start", "end", F.col("attrs")["exon_id"].alias("exon"))
    return children.join(exons, "transcript").groupBy("gene", "start", "end").agg(F.sort_array(F.collect_set("exon")).alias("exon_ids"))


#: What a curation list is of -> its columns.
LISTS = {"curation": ["curation", "gene", "gene_label", "disease", "disease_label"], "gene": ["gene", "gene_label"], "disease": ["disease", "disease_label"]}


def curation_list(curations: DataFrame, contributions: DataFrame, role: str | None = None, affiliation: str | None = None, text: str | None = None, of: str = "curation") -> DataFrame:
    """Distinct validity curations, or their genes or diseases (of), with a contribution in the role (G14). Pages and counts: aggregates.page().

    curations: (curation, gene, gene_label, disease, disease_label); contributions: (curation, agent, role). role: APPROVER
    where none is given, ANY for all; text: part of a label, in any case.
    """
    some = contributions if role == "ANY" else contributions.where(F.col("role") == (role or "APPROVER"))
    some = some if affiliation is None else some.where(F.col("agent") == affiliation)
    rows = curations.join(some, "curation", "left_semi")
    if text is not None:
        rows = rows.where(F.contains(F.lower("gene_label"), F.lit(text.lower())) | F.contains(F.lower("disease_label"), F.lit(text.lower())))
    return rows.select(*LISTS[of]).distinct()


def affiliation_counts(curations: DataFrame, contributions: DataFrame) -> DataFrame:
    """Per agent the number of its curations, in all and by role."""
    rows = contributions.join(curations, "curation", "left_semi").distinct()
    by_role = lambda r: F.countDistinct(F.when(F.col("role") == r, F.col("curation")))
    return rows.groupBy("agent").agg(F.countDistinct("curation").alias("n_curations"), by_role("APPROVER").alias("n_approved"), by_role("SECONDARY_CONTRIBUTOR").alias("n_secondary"))


def profile(df: DataFrame, *columns: str) -> DataFrame:
    """(column, value, n): counts per value of each column in one pass."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(cells.alias("c")).groupBy("c.column", "c.value").agg(F.count("*").alias("n"))


def foreign_types(types: DataFrame, own: str, labels: DataFrame | None = None) -> DataFrame:
    """Distinct types outside a namespace."""
    return types.where(~F.startswith("type", F.lit(own))).select("type").distinct()


def first_years(df: DataFrame, key: str, date: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(date)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(key, F.year(date).alias("year"))
