"""Predicates, feature sets and named assertion filters (F10-F24, FS1-FS7, NF1-NF15, O1-O8)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab
from . import intervals
from .overlap_sums import complete_counts, overlap_sums, set_hits

# ---- predicates --------------------------------------------------------------------------------------------------


def date_after(column: str, argument: str) -> Column:
    """argument < date, as text, so a year alone works."""
    return F.lit(argument) < F.col(column)


def date_between(column: str, after: str, before: str) -> Column:
    return (F.col(column) > after) & (F.col(column) < before)


def is_cnv(variant_type: str = "variant_type", copy_count: str = "copy_count", locations: str = "locations") -> Column:
    """A copy-number type with a copy count or a displayed length over 1000; missing coordinates count as length -1."""
    longest = F.coalesce(F.array_max(F.transform(F.col(locations), lambda x: F.coalesce(x["display_stop"] - x["display_start"], F.lit(-1)))), F.lit(-1))
    return F.col(variant_type).isin(*vocab.CNV_TYPES) & (F.col(copy_count).isNotNull() | (longest > 1000))


def has_role(contributions: str, role: str) -> Column:
    """Some contribution has the role (F16)."""
    return F.coalesce(F.exists(F.col(contributions), lambda c: c["role"] == role), F.lit(False))


def dosage_record_ok(status: str = "status", resolution: str = "resolution", date: str = "resolutiondate") -> Column:
    return F.coalesce((F.col(status) == "Closed") & (F.col(resolution) == "Complete") & F.col(date).isNotNull(), F.lit(False))


def mentions(column: str, text: str) -> Column:
    """Contains the text in any case; null doesn't."""
    return F.coalesce(F.contains(F.lower(F.col(column)), F.lit(text.lower())), F.lit(False))


def matches(column: str, pattern: str) -> Column:
    """The pattern is found in the text; null has none."""
    return F.coalesce(F.rlike(column, F.lit(pattern)), F.lit(False))


def is_lof_deletion(alt="alt", filt="filter", length="svlen", lof="predicted_lof") -> Column:
    return F.coalesce((F.col(alt) == "<DEL>") & (F.col(filt) == "PASS") & (F.col(length).try_cast("bigint") > 1000) & F.col(lof).isNotNull(), F.lit(False))


VALID_PERSON_EVENTS = ("created", "person_created", "person_updated", "updated")


def valid_event(column: str = "event_type", types: tuple[str, ...] = VALID_PERSON_EVENTS) -> Column:
    """The event is of one of the types; a null one isn't."""
    return F.coalesce(F.col(column).isin(*types), F.lit(False))


def in_open_range(column: str, low: float, high: float) -> Column:
    return (F.col(column) > low) & (F.col(column) < high)


def no_nulls(df: DataFrame, *columns: str) -> DataFrame:
    return df.dropna(subset=list(columns) or None)


# ---- tables that filters look into -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    """The tables a filter may use: assertions, variants, overlaps (variant, feature, kind), mechanism, validity, features, annotations, criteria; invalidated holds assertion ids.

    Without an overlaps table, overlaps are joined from the locations of variants and features, for the features that a
    filter asks for alone; one_location is that of intervals.overlaps(), and with it overlaps are counted, not joined.
    Without criteria, gene counts are taken from the overlaps.
    """

    assertions: DataFrame
    variants: DataFrame | None = None
    overlaps: DataFrame | None = None
    mechanism: DataFrame | None = None
    validity: DataFrame | None = None
    features: DataFrame | None = None
    annotations: DataFrame | None = None
    criteria: DataFrame | None = None
    propositions: DataFrame | None = None
    invalidated: DataFrame | None = None
    one_location: bool = False

    def overlaps_with(self, features: DataFrame) -> DataFrame:
        """Overlaps of all variants with some features (feature)."""
        if self.overlaps is not None:
            return self.overlaps.join(features, "feature", "left_semi")
        return intervals.overlaps(self.variants, self.features.join(features, "feature", "left_semi"), one_location=self.one_location)


    def variants_over(self, features: DataFrame, kind: str) -> DataFrame:
        """Variants that overlap some of the features (feature) with the kind."""
        if self.overlaps is None and self.one_location:
            return set_hits(self.variants, self.features, features.select("feature", F.lit("s").alias("feature_set")), ["s"], (kind,)).select("variant")
        return self.overlaps_with(features).where(F.col("kind") == kind).select("variant").distinct()

    def gene_criteria(self) -> DataFrame:
        if self.criteria is not None:
            return self.criteria
        if self.overlaps is None and self.one_location:
            return intervals.criteria_of_counts(complete_counts(self.variants, self.features))
        return intervals.gene_count_criteria(self.overlaps if self.overlaps is not None else intervals.overlaps(self.variants, self.features, one_location=self.one_location))


# ---- feature sets ------------------------------------------------------------------------------------------------

MODERATE_OR_MORE = ("Moderate", "Strong", "Definitive")


def feature_set(m: Model, name: str, compat: bool = False) -> DataFrame:
    """Distinct features of a named set. compat: the AR set is the ADXL one, as the service's name table has it."""
    if name == "HaploinsufficiencyFeatures":
        return m.mechanism.where("mechanism = 'Haploinsufficiency' and strength = 'DosageSufficientEvidence'").select("feature").distinct()
    if name == "TriplosensitivityFeatures":
        return m.mechanism.where("mechanism = 'Triplosensitivity' and strength = 'DosageSufficientEvidence'").select("feature").distinct()
    strong = m.validity.where(F.col("strength").isin(*MODERATE_OR_MORE)) if m.validity is not None else None
    genes = lambda df: df.select(F.col("gene").alias("feature")).distinct()
    if name == "GeneValidityModerateAndGreater":
        return genes(strong)
    if name == "GeneValidityModerateAndGreaterADXL" or (compat and name == "GeneValidityModerateAndGreaterAR"):
        return genes(strong.where("moi in ('AD', 'XL')"))
    if name == "GeneValidityModerateAndGreaterAR":
        return genes(strong.where("moi = 'AR'"))
    if name == "ARGene":
        dosage = m.mechanism.where("strength = 'DosageAutosomalRecessive'").select("feature")
        return genes(strong.where("moi = 'AR'")).unionByName(dosage).distinct()
    if name == "ProteinCodingGenes":
        return m.features.where("protein_coding").select("feature").distinct()
    raise ValueError(f"no feature set {name}")


# ---- named filters -----------------------------------------------------------------------------------------------


#: Filters that look for a kind of overlap with a feature set.
OVERLAP_KINDS = {"complete_overlap_with_feature_set": "CompleteOverlap", "partial_overlap_with_feature_set": "PartialOverlap"}


def _by_overlap(kind: str) -> Callable[[Model, str], DataFrame]:
    def found(m: Model, argument: str) -> DataFrame:
        return m.assertions.join(m.variants_over(feature_set(m, argument), kind), "variant", "left_semi").select("assertion")

    return found


def _proposition_type(m: Model, argument: str) -> DataFrame:
    return m.assertions.join(m.propositions.where(F.col("type") == argument), "proposition", "left_semi").select("assertion")


def _has_annotation(m: Model, argument: str | None) -> DataFrame:
    a = m.annotations if argument is None else m.annotations.where(F.col("classification") == argument)
    return a.select(F.col("subject").alias("assertion")).distinct()


def _about_gene(m: Model, argument: str) -> DataFrame:
    return m.assertions.where(F.col("gene") == argument).select("assertion")


def _about_symbol(m: Model, argument: str) -> DataFrame:
    genes = m.features.where(F.col("symbol") == argument).select(F.col("feature").alias("gene"))
    return m.assertions.join(genes, "gene", "left_semi").select("assertion")


#: name -> (function to the rows it keeps, description). Open to more.
FILTERS: dict[str, tuple[Callable[[Model, str | None], DataFrame], str]] = {
    "proposition_type": (_proposition_type, "subject proposition has the type"),
    "copy_change": (lambda m, a: m.assertions.join(m.variants.where(F.col("copy_change") == a), "variant", "left_semi").select("assertion"), "variant has the copy change"),
    "assertion_direction": (lambda m, a: m.assertions.where(F.col("direction") == a).select("assertion"), "direction equals"),
    "complete_overlap_with_feature_set": (_by_overlap(OVERLAP_KINDS["complete_overlap_with_feature_set"]), "variant completely overlaps a feature of the set"),
    "partial_overlap_with_feature_set": (_by_overlap(OVERLAP_KINDS["partial_overlap_with_feature_set"]), "variant partially overlaps a feature of the set"),
    "gene_count_min": (lambda m, a: m.assertions.join(m.gene_criteria().where(F.col("criterion") == a), "variant", "left_semi").select("assertion"), "variant meets the gene-count criterion"),
    "date_evaluated_min": (lambda m, a: m.assertions.where(date_after("date_last_evaluated", a)).select("assertion"), "evaluated after the date"),
    "has_annotation": (_has_annotation, "annotated, with the classification if one is given"),
    "has_assertion": (lambda m, a: m.validity.select(F.col("gene").alias("assertion")).distinct(), "feature is the gene of an asserted proposition"),
    "is_about_gene": (_about_gene, "proposition's gene equals"),
    "is_about_gene_symbol": (_about_symbol, "proposition's gene has the symbol"),
    "submitter": (lambda m, a: m.assertions.where(F.col("submitter") == a).select("assertion"), "submitter equals"),
    "is_obsolete": (lambda m, a: m.invalidated.select("assertion").distinct(), "invalidated by something"),
}
OPERATIONS = ("exists", "not_exists", "union", "difference")


def apply_filters(m: Model, calls: list[dict], base: DataFrame | None = None, compat: bool = False) -> DataFrame:
    """Rows of base (default: all assertions) after each call {filter, argument, operation} in turn (F7, NF14).

    exists and not_exists are semi and anti joins; union adds a filter's rows, difference takes them away. compat: all
    operations but not_exists act as exists.
    """
    kept = (m.assertions if base is None else base).select("assertion").distinct()
    for call in calls:
        op = call.get("operation", "exists")
        rows = FILTERS[call["filter"]][0](m, call.get("argument"))
        if compat and op != "not_exists":
            op = "exists"
        if op == "exists":
            kept = kept.join(rows, "assertion", "left_semi")
        elif op in ("not_exists", "difference"):
            kept = kept.join(rows, "assertion", "left_anti")
        elif op == "union":
            kept = kept.unionByName(rows).distinct()
        else:
            raise ValueError(f"no operation {op}")
    return kept


def filter_bits(m: Model, calls: list[tuple[str, str | None]]) -> DataFrame:
    """Assertions with a column bits: bit i is set where call i (filter, argument) keeps the row. At most 63 calls.

    All overlap filters are answered by one interval join (with one_location: by one count per variant, without pairs), over
    the features of all their sets; the others' rows are folded by assertion in one aggregation. Where the model has no
    criteria, gene counts come from that same join or count, which then takes all features.
    """
    if len(calls) > 63:
        raise ValueError("more than 63 calls")
    counted = [(i, a) for i, (f, a) in enumerate(calls) if f == "gene_count_min" and m.criteria is None]
    near = [(i, OVERLAP_KINDS[f], a) for i, (f, a) in enumerate(calls) if f in OVERLAP_KINDS]
    joined = {i for i, *_ in [*counted, *near]}
    flags = None
    for i, (f, a) in enumerate(calls):
        if i not in joined:
            rows = FILTERS[f][0](m, a).select("assertion", F.lit(1 << i).cast("long").alias("bits"))
            flags = rows if flags is None else flags.unionByName(rows)
    out = m.assertions
    zero = F.lit(0).cast("long")
    bits = zero
    if flags is not None:
        out = out.join(flags.groupBy("assertion").agg(F.bit_or("bits").alias("_own")), "assertion", "left")
        bits = bits.bitwiseOR(F.coalesce("_own", zero))
    if joined:
        names = sorted({a for _, _, a in near})
        sets = None
        for j, name in enumerate(names):
            rows = feature_set(m, name).select("feature", F.lit(1 << j).alias("sets"))
            sets = rows if sets is None else sets.unionByName(rows)
        if sets is not None:
            sets = sets.groupBy("feature").agg(F.bit_or("sets").cast("long").alias("sets"))
        if m.overlaps is None and m.one_location:
            told = _told_by_counts(m, sets, names, near, bool(counted))
        elif counted:
            hit = m.overlaps if m.overlaps is not None else intervals.overlaps(m.variants, m.features, one_location=m.one_location)
            hit = hit.withColumn("sets", zero) if sets is None else hit.join(sets, "feature", "left").withColumn("sets", F.coalesce("sets", zero))
        else:
            hit = m.overlaps_with(sets.select("feature")).join(sets, "feature")
        if m.overlaps is not None or not m.one_location:
            each = zero
            for i, kind, a in near:
                each = each.bitwiseOR(F.when((F.col("kind") == kind) & (F.col("sets").bitwiseAND(F.lit(1 << names.index(a))) != 0), F.lit(1 << i).cast("long")).otherwise(zero))
            told = hit.groupBy("variant").agg(F.bit_or(each).alias("_near"), F.count_if(F.col("kind") == "CompleteOverlap").alias("_genes"))
        many, least = zero, {name: n for n, name in vocab.GENE_COUNT_CRITERIA.items()}
        for i, name in counted:
            many = many.bitwiseOR(F.when(F.col("_genes") >= least[name], F.lit(1 << i).cast("long")).otherwise(zero))
        out = out.join(told.select("variant", F.col("_near").bitwiseOR(many).alias("_near")), "variant", "left")
        bits = bits.bitwiseOR(F.coalesce("_near", zero))
    return out.withColumn("bits", bits).drop("_own", "_near")


def _told_by_counts(m: Model, sets: DataFrame | None, names: list[str], near: list[tuple[int, str, str]], counted: bool) -> DataFrame:
    """(variant, _near, _genes): the bits of the overlap filters and the number of completely overlapped features."""
    measures = {f"s{j}": F.coalesce(F.shiftright("sets", j).bitwiseAND(F.lit(1).cast("long")), F.lit(0)) for j in range(len(names))}
    features = m.features if sets is None else m.features.join(sets, "feature", "left" if counted else "inner")
    if counted:
        measures["n"] = F.lit(1)
    kinds = [k for k in vocab.OVERLAP_ORDER if any(k == kind for _, kind, _ in near) or (counted and k == "CompleteOverlap")]
    met = overlap_sums(m.variants, features, measures, kinds)
    met = met.groupBy("variant").agg(*[F.sum(c).alias(c) for c in met.columns if c != "variant"])
    bits = F.lit(0).cast("long")
    for i, kind, a in near:
        bits = bits.bitwiseOR(F.when(F.col(f"s{names.index(a)}_{kind}") > 0, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return met.select("variant", bits.alias("_near"), (F.col("n_CompleteOverlap") if counted else F.lit(0)).alias("_genes"))


def list_filters(spark: SparkSession) -> DataFrame:
    """The advertised filters (NF15)."""
    return spark.createDataFrame([(k, v[1]) for k, v in FILTERS.items()], "filter string, description string")


# ---- set operations (O1-O8) --------------------------------------------------------------------------------------


def union_distinct(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.distinct()


def difference(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    return left.select(on).distinct().join(right.select(on), on, "left_anti")


def set_differences(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows with the two one-sided differences of their arrays."""
    return df.withColumns({"only_a": F.sort_array(F.array_except(a, b)), "only_b": F.sort_array(F.array_except(b, a)), "both": F.sort_array(F.array_intersect(a, b))})


def compare_snapshots(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Per key: only_old, only_new, same or changed, and which columns differ."""
    columns = [c for c in old.columns if c != key and c in new.columns]
    a = old.select(key, F.struct(*columns).alias("a"))
    b = new.select(key, F.struct(*columns).alias("b"))
    differ = F.array_compact(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), c) for c in columns]))
    both = a.join(b, key, "full")
    state = F.when(F.col("b").isNull(), "only_old").when(F.col("a").isNull(), "only_new").when(F.size(differ) == 0, "same").otherwise("changed")
    return both.select(key, state.alias("state"), F.when(state == "changed", differ).otherwise(F.array().cast("array<string>")).alias("differs"))
