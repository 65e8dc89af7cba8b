"""Reports on curated statements, their evidence, papers and contributors.

Every report aggregates its long tables (evidence, citations, contributions) by statement once, and joins one row per
statement. Columns are named in each function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph
from .aggregates import best_ranked, latest, statistics
from .filters import MODERATE_OR_MORE

NEW_REASONS = ("cg:NewCuration",)
AGAIN_REASONS = (
    "cg:RecurationCommunityRequest", "cg:RecurationDiscrepancyResolution", "cg:RecurationErrorAffectingScoreorClassification", "cg:RecurationTiming", "cg:RecurationNewEvidence",
)


def _first_agent(roles: DataFrame, role: str, key: str) -> DataFrame:
    """(key, agent, date): one contribution of a role per key, the first by agent and date."""
    one = roles.where(F.col("role") == role).groupBy(key).agg(F.min(F.struct("agent", "date")).alias("c"))
    return one.select(key, "c.agent", "c.date")


def points_by_year(versions: DataFrame, lines: DataFrame, papers: DataFrame, first: int = 2000, last: int = 2025) -> DataFrame:
    """One row per record: its last version with total points, earliest publication, segregation points, points per year of
    publication, the score difference (total less all papers' points) and what each version was (X30).

    versions: (record, curation, version, ts, classification, total); lines: (curation, paper, points, segregation: boolean);
    papers: (paper, year). Versions whose earliest paper is older than `first`, or that have no dated paper, are left out.
    """
    dated = lines.join(papers, "paper", "left")
    years = [F.coalesce(F.sum(F.when(F.col("year") == y, F.col("points"))), F.lit(0)).alias(f"y{y}") for y in range(first, last + 1)]
    sums = dated.groupBy("curation").agg(
        F.min("year").alias("earliest"), F.coalesce(F.sum(F.when(F.col("segregation"), F.col("points"))), F.lit(0)).alias("segregation_points"),
        F.coalesce(F.sum(F.when(F.col("paper").isNotNull(), F.col("points"))), F.lit(0)).alias("paper_points"), *years,
    )
    told = versions.join(sums, "curation").where(F.col("earliest") >= first)
    infos = told.groupBy("record").agg(F.sort_array(F.collect_list(F.struct("ts", "curation", "version", "classification", "total"))).alias("versions"))
    shown = told.withColumn("difference", F.col("total") - F.col("paper_points"))
    return latest(shown, "record", "ts", "curation").join(infos, "record").select("record", "curation", "version", "classification", "total", "earliest", "segregation_points", "difference", *[f"y{y}" for y in range(first, last + 1)], "versions")


def recurations(versions: DataFrame, roles: DataFrame, role: str, key: str = "curation") -> DataFrame:
    """(agent, n_new, n_again): new curations and recurations by the agent of a role: Approver for affiliations, SecondaryContributor.

    versions: (curation, reasons). A version whose reasons name both counts as new, one that names neither not at all.
    """
    holds = lambda names: F.coalesce(F.arrays_overlap("reasons", F.lit(list(names))), F.lit(False))
    told = versions.select(key, holds(NEW_REASONS).alias("new"), holds(AGAIN_REASONS).alias("again")).where("new or again")
    return told.join(_first_agent(roles, role, key).where("agent is not null"), key).groupBy("agent").agg(F.count_if("new").alias("n_new"), F.count_if(~F.col("new")).alias("n_again"))


def weak_statements(statements: DataFrame, evidence: DataFrame, roles: DataFrame, citations: DataFrame, papers: DataFrame, classes: tuple[str, ...] = ("Limited", "Disputed", "Refuted")) -> DataFrame:
    """The twelve columns of the report on weak statements (X27): gene, disease, moi, classification, gcep, approval_date,
    first_publication, publication_date, overall, genetic, experimental, version.

    statements: (stmt, gene, disease, moi, classification, overall, version); evidence: (stmt, criteria, score), the greatest
    score of genetic and experimental evidence is told; citations: (stmt, paper); papers: (paper, date).
    """
    some = statements.where(F.col("classification").isin(*classes))
    score = lambda c: F.max(F.when(F.col("criteria") == c, F.col("score"))).alias(c)
    scores = evidence.groupBy("stmt").agg(score("genetic"), score("experimental"))
    first = citations.join(papers.where(F.col("date").isNotNull()), "paper").groupBy("stmt").agg(F.min(F.struct("date", "paper")).alias("p"))
    first = first.select("stmt", F.col("p.paper").alias("first_publication"), F.col("p.date").alias("publication_date"))
    approved = _first_agent(roles, "Approver", "stmt").select("stmt", F.col("agent").alias("gcep"), F.col("date").alias("approval_date"))
    told = some.join(approved, "stmt", "left").join(first, "stmt", "left").join(scores, "stmt", "left")
    return told.select("gene", "disease", "moi", "classification", "gcep", "approval_date", "first_publication", "publication_date", "overall", "genetic", "experimental", "version")


def best_candidates(validity: DataFrame, mechanism: DataFrame, order: list[str]) -> DataFrame:
    """(gene, strength, disease, several): genes of moderate or better validity without a mechanism proposition, with their
    best classification and whether they have several statements (X33, J5, W4)."""
    strong = validity.where(F.col("strength").isin(*MODERATE_OR_MORE))
    free = strong.join(mechanism.select(F.col("feature").alias("gene")), "gene", "left_anti")
    return best_ranked(free, "gene", "strength", order, "disease").select("gene", "strength", "disease", "several")


def probands(statements: DataFrame, evidence: DataFrame, has_variant: DataFrame, items: DataFrame) -> DataFrame:
    """(stmt, n): how many probands each statement's evidence holds, by the path evidence* and at most one inverse step has-variant.

    evidence: (child, parent) from a node to its evidence; has_variant: (s, o); items: (node) that are probands. Only what
    the statements reach is walked.
    """
    reached = graph.reachable(evidence, statements.select(F.col("stmt").alias("root")))
    back = reached.join(has_variant.select(F.col("o").alias("node"), F.col("s").alias("to")), "node").select("root", F.col("to").alias("node"))
    found = reached.select("root", "node").unionByName(back).join(items.select("node"), "node", "left_semi").distinct()
    counts = found.groupBy(F.col("root").alias("stmt")).agg(F.count("*").alias("n"))
    return statements.select("stmt").join(counts, "stmt", "left").select("stmt", F.coalesce("n", F.lit(0)).alias("n"))


def proband_statistics(statements: DataFrame, counts: DataFrame) -> DataFrame:
    """Mean, median, least and most probands per inheritance and classification (X34, A9). statements: (stmt, moi, classification)."""
    told = statements.join(counts.select("stmt", F.col("n").alias("n_probands")), "stmt")
    return statistics(told, "n_probands", "moi", "classification")


ADULT, PAEDIATRIC = "AdultActionabilityWorkingGroup", "PaediatricActionabilityWorkingGroup"


def curation_statistics(reports: DataFrame, roles: DataFrame, parts: DataFrame, scores: DataFrame, ruled_out: DataFrame) -> DataFrame:
    """(statistic, value): the figures of actionability curation, total and by working group.

    reports: (report, version); roles: (report, role, agent); parts: (report, gene, disease), preferred conditions;
    scores: (report, score), one row per outcome and intervention pair; ruled_out: (report), one row per failed early rule-out.
    Figures by group count a report's rows once per contribution of the group, as the joins do; pairs are distinct.
    """
    by_group = lambda df, on: df.join(roles.where(on).select("report", "agent"), "report")
    any_role, approver = F.lit(True), F.col("role") == "ApproverRole"

    def figure(name: str, df: DataFrame, value: Column) -> DataFrame:
        return df.agg(value.cast("string").alias("value")).select(F.lit(name).alias("statistic"), "value")

    n = F.count("*")
    out = [figure("reports", reports, n), figure("updated_reports", reports.where(F.rlike("version", F.lit("[2-9].[0-9].[0-9]"))), n)]
    pairs = by_group(parts, any_role).select("gene", "disease", "agent")
    out.append(figure("gene_disease_pairs", pairs.select("gene", "disease").distinct(), n))
    told = by_group(scores, approver).select("score", "agent")
    out.append(figure("outcome_intervention_pairs", told, n))
    for name, group in (("adult", ADULT), ("paediatric", PAEDIATRIC)):
        mine = F.col("agent") == group
        out.append(figure(f"{name}_gene_disease_pairs", pairs.where(mine).select("gene", "disease").distinct(), n))
        counts = told.where(mine).groupBy("score").agg(F.count("*").alias("n"))
        text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("score", "n"))), lambda x: F.concat(x["score"].cast("string"), F.lit("="), x["n"].cast("string"))), " ")
        out.append(figure(f"{name}_scores", counts, text))
        out.append(figure(f"{name}_outcome_intervention_pairs", told.where(mine), n))
        out.append(figure(f"{name}_failed_early_rule_out", by_group(ruled_out, any_role).where(mine), n))
    whole = out[0]
    for df in out[1:]:
        whole = whole.unionByName(df)
    return whole


def version_sheet(versions: DataFrame, recurated: bool) -> DataFrame:
    """(record, gene, disease, moi, earliest, versions): records of several versions that were curated again, or those that never
    were, with the latest version of each major one as repeated columns (X29, W3, W9).

    versions: (record, version, date, classification, total, genetic, experimental, gene, disease, moi, earliest). A version
    is later if its text is greater, its major part is the first character; a record was curated again if any isn't 1. What
    is told of a record itself is its latest version's.
    """
    majors = versions.withColumn("major", F.substring("version", 1, 1))
    kinds = majors.groupBy("record").agg(F.count("*").alias("n"), F.coalesce(F.max(F.col("major") != "1"), F.lit(False)).alias("again"))
    chosen = kinds.where("n > 1 and again") if recurated else kinds.where("not again")
    last = latest(majors.join(chosen.select("record"), "record", "left_semi"), ["record", "major"], "version", "date")
    one = F.struct("major", "version", "date", "classification", "total", "genetic", "experimental")
    whole = last.groupBy("record").agg(F.max(F.struct("version", "date", "gene", "disease", "moi", "earliest")).alias("l"), F.sort_array(F.collect_list(one)).alias("versions"))
    return whole.select("record", "l.gene", "l.disease", "l.moi", "l.earliest", F.transform("versions", lambda v: v.dropFields("major", "version")).alias("versions"))


def inheritance_table(lof: DataFrame, features: DataFrame, mechanism: DataFrame, validity: DataFrame, shared: DataFrame) -> DataFrame:
    """(gene, symbol, score, haplo, moi, shared_moi) by descending score: scored genes with their haploinsufficiency strength and the
    inheritance modes of their own curations and of shared ones, each list sorted with its repetitions (X17)."""
    haplo = mechanism.where("mechanism = 'Haploinsufficiency'").groupBy(F.col("feature").alias("gene")).agg(F.min("strength").alias("haplo"))
    listed = lambda df, name: df.groupBy("gene").agg(F.sort_array(F.collect_list("moi")).alias(name))
    names = features.select(F.col("feature").alias("gene"), "symbol")
    told = lof.join(names, "gene", "left").join(haplo, "gene", "left").join(listed(validity, "moi"), "gene", "left").join(listed(shared, "shared_moi"), "gene", "left")
    none = F.array().cast("array<string>")
    return told.select("gene", "symbol", F.col("lower95").alias("score"), "haplo", F.coalesce("moi", none).alias("moi"), F.coalesce("shared_moi", none).alias("shared_moi")).orderBy(F.desc("score"), "gene")


def assertions_about(propositions: DataFrame, assertions: DataFrame, invalidated: DataFrame, proposition_type: str | None = None) -> DataFrame:
    """(feature, assertion): assertions whose proposition names the feature as gene, feature or subject, of a type if one is given, that nothing invalidated.

    propositions: (proposition, type, gene, feature, subject); assertions: (assertion, proposition); invalidated: (assertion).
    """
    some = propositions if proposition_type is None else propositions.where(F.col("type") == proposition_type)
    named = some.select("proposition", F.explode(F.array_distinct(F.array_compact(F.array("gene", "feature", "subject")))).alias("feature"))
    return assertions.join(named, "proposition").join(invalidated.select("assertion"), "assertion", "left_anti").select("feature", "assertion").distinct()


def entity_types(types: DataFrame, labels: DataFrame, local: str) -> DataFrame:
    """(type, label, n): types outside the local namespace with their label, if they have one, and how many nodes have them (X42). types: (node, type); labels: (node, label)."""
    counts = types.where(~F.startswith("type", F.lit(local))).groupBy("type").agg(F.count_distinct("node").alias("n"))
    named = labels.groupBy(F.col("node").alias("type")).agg(F.min("label").alias("label"))
    return counts.join(named, "type", "left").select("type", "label", "n")
