"""Gene-set similarity and conflicts between assertions.

Assertions with equal gene sets are one group; groups are compared, not assertions, by joining their exploded genes and
counting what they share. So a gene that many assertions name costs pairs of distinct sets, not of assertions, and
pairs without a shared gene are never made.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import intervals, ranges


def gene_groups(sets: DataFrame, key: str = "assertion", gene: str = "gene", by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(members: key, group, *by) and (groups: group, n, genes, *by) of equal gene sets within `by`."""
    by = by or []
    one = sets.groupBy(key, *by).agg(F.sort_array(F.collect_set(gene)).alias("genes")).withColumn("group", F.sha2(F.concat_ws("|", "genes", *by), 256))
    return one.select(key, "group", *by), one.select("group", F.size("genes").alias("n"), "genes", *by).dropDuplicates(["group"])


def shared_counts(groups: DataFrame, on: list[str] | None = None) -> DataFrame:
    """(group, other, n, n_other, shared) of groups that share a gene, each with itself too."""
    on = on or []
    flat = groups.select("group", "n", *on, F.explode("genes").alias("gene"))
    other = flat.select(F.col("group").alias("other"), F.col("n").alias("n_other"), *on, "gene")
    return flat.join(other, ["gene", *on]).groupBy("group", "other").agg(F.first("n").alias("n"), F.first("n_other").alias("n_other"), F.count("*").alias("shared"))


def distinct_sets(sets: DataFrame, key: str = "assertion", gene: str = "gene") -> DataFrame:
    """(group, n, genes): the distinct gene sets, numbered and written."""
    one = sets.groupBy(key).agg(F.sort_array(F.collect_set(gene)).alias("genes"))
    return ranges.written(one.groupBy("genes").agg(F.lit(1)).select(F.monotonically_increasing_id().alias("group"), F.size("genes").alias("n"), "genes"), "sets")


def _gene_pairs(groups: DataFrame, *columns: str) -> DataFrame:
    """A row per two genes of a set, as a hash of both; genes are in order, so equal pairs have equal hashes."""
    first = groups.select(*columns, "genes", F.posexplode("genes").alias("_i", "_a"))
    both = first.select(*columns, "_a", F.explode(F.slice("genes", F.col("_i") + 2, F.greatest(F.size("genes") - F.col("_i") - 1, F.lit(0)))).alias("_b"))
    return both.select(*columns, F.xxhash64("_a", "_b").alias("pair"))


def shared_size_counts(groups: DataFrame, most_genes: int = 32) -> DataFrame:
    """(n, n_other, shared, n_pairs): how many ordered pairs of sets, each with itself too, share so many genes, by their sizes.

    groups: as distinct_sets() has them. Only pairs that share two genes or more are made, from pairs of genes that several
    sets hold; what two sets share adds up over genes to products of counts, so those that share one gene are what is left
    of these. Sets of more than most_genes genes have too many pairs of genes and are joined by single genes.
    """
    sizes = groups.groupBy("n").agg(F.count("*").alias("c")).where("n > 0")
    small, large = groups.where(F.col("n") <= most_genes), groups.where(F.col("n") > most_genes)
    held = small.select("n", F.explode("genes").alias("gene")).groupBy("gene", "n").agg(F.count("*").alias("c"))
    by_gene = held.groupBy("gene").agg(F.collect_list(F.struct("n", "c")).alias("x")).withColumn("a", F.explode("x")).withColumn("b", F.explode("x"))
    total = by_gene.groupBy(F.col("a.n").alias("n"), F.col("b.n").alias("n_other")).agg(F.sum(F.col("a.c") * F.col("b.c")).alias("total"))
    several = ranges.written(_gene_pairs(small).groupBy("pair").agg(F.count("*").alias("c")).where("c > 1").select("pair"), "pairs")
    some = ranges.written(_gene_pairs(small, "group").join(several, "pair"), "holders")
    met = some.join(some.select("pair", F.col("group").alias("other")), "pair").where("group < other").select("group", "other").distinct()
    told = small.select("group", "n", "genes").join(some.select("group").distinct(), "group", "left_semi")
    met = met.join(told, "group").join(told.select(F.col("group").alias("other"), F.col("n").alias("n_other"), F.col("genes").alias("others")), "other")
    met = met.select("n", "n_other", F.size(F.array_intersect("genes", "others")).cast("long").alias("shared")).where("shared > 1")
    both = lambda df, n: df.unionByName(df.select(F.col("n_other").alias("n"), F.col("n").alias("n_other"), "shared", n))
    itself = sizes.where(F.col("n").between(2, most_genes)).select("n", F.col("n").alias("n_other"), F.col("n").cast("long").alias("shared"), F.col("c").alias("n_pairs"))
    more = both(met.groupBy("n", "n_other", "shared").agg(F.count("*").alias("n_pairs")), "n_pairs").unionByName(itself)
    more = ranges.written(more.groupBy("n", "n_other", "shared").agg(F.sum("n_pairs").alias("n_pairs")), "shared")
    rest = more.groupBy("n", "n_other").agg(F.sum(F.col("shared") * F.col("n_pairs")).alias("more"))
    ones = total.join(rest, ["n", "n_other"], "left").select("n", "n_other", F.lit(1).cast("long").alias("shared"), (F.col("total") - F.coalesce("more", F.lit(0))).alias("n_pairs")).where("n_pairs > 0")
    out = ones.unionByName(more)
    if not large.isEmpty():
        flat = groups.select("group", "n", F.explode("genes").alias("gene"))
        other = flat.select(F.col("group").alias("other"), F.col("n").alias("n_other"), "gene")
        wide = flat.where(F.col("n") > most_genes).join(other, "gene").groupBy("group", "other").agg(F.first("n").alias("n"), F.first("n_other").alias("n_other"), F.count("*").alias("shared"))
        wide = wide.groupBy("n", "n_other", "shared").agg(F.count("*").alias("n_pairs"))
        mixed = wide.where(F.col("n_other") <= most_genes).select(F.col("n_other").alias("n"), F.col("n").alias("n_other"), "shared", "n_pairs")
        out = out.unionByName(wide).unionByName(mixed)
    return out


def jaccard_counts(groups: DataFrame, least: float) -> DataFrame:
    """(n_small, n_large, shared, n_pairs): how many pairs of different sets jaccard_sets() has, by their sizes and what they share."""
    counts = shared_size_counts(groups).where("n <= n_other")
    itself = groups.groupBy("n").agg(F.count("*").alias("own")).select("n", F.col("n").alias("n_other"), F.col("n").cast("long").alias("shared"), "own")
    counts = counts.join(itself, ["n", "n_other", "shared"], "left")
    pairs = F.when(F.col("n") == F.col("n_other"), F.expr("(n_pairs - coalesce(own, 0)) div 2")).otherwise(F.col("n_pairs"))
    near = F.col("shared") * (1 + least) >= (F.col("n") + F.col("n_other")) * least - 1e-9
    return counts.where(near).select(F.col("n").alias("n_small"), F.col("n_other").alias("n_large"), "shared", pairs.alias("n_pairs")).where("n_pairs > 0")


def _prefixes(groups: DataFrame, often: DataFrame, length: Column, on: list[str]) -> DataFrame:
    """(group, n, genes, *on, gene, place): the `length` rarest genes of each set, with their places in the order from rare to frequent."""
    flat = groups.select("group", "n", "genes", *on, F.explode("genes").alias("gene")).join(often, ["gene", *on], "left")
    rare = F.sort_array(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "gene")))
    ranked = flat.groupBy("group", "n", "genes", *on).agg(rare.alias("rare"))
    return ranked.select("group", "n", "genes", *on, F.posexplode(F.slice("rare", F.lit(1), F.greatest(length, F.lit(0)).cast("int"))).alias("place", "x")).select("group", "n", "genes", *on, "place", F.col("x.gene").alias("gene"))


def similar_sets(left: DataFrame, right: DataFrame, need: Callable[[Column, Column], Column], left_need: Column, right_need: Column | None = None, window: Callable[[Column, Column], Column] | None = None, on: list[str] | None = None) -> DataFrame:
    """(group, other, n, n_other, shared): pairs of sets that share at least need(n, n_other) genes.

    Sides are groups (group, n, genes, *on), distinct sets each. left_need (of column n) is the least that a left set must
    share with any partner, right_need the like for a right one (None: nothing is known, as where left sets may be small).
    A pair that shares m genes meets in one of the n - m + 1 rarest genes of either side, so only these are joined, and of
    both sides where both bounds are known: a gene that most sets hold is in the prefix of those alone that have little
    else. A pair is kept in the first gene of the left prefix in which it meets, if what is left of both sets from there
    can still make the need (positions), and the size window holds. What remains is counted exactly.
    """
    on = on or []
    genes = lambda df: df.select(*on, F.explode("genes").alias("gene"))
    often = genes(left).unionByName(genes(right)).groupBy("gene", *on).agg(F.count("*").alias("often"))
    a = _prefixes(left, often, F.col("n") - left_need + 1, on)
    b = _prefixes(right, often, F.col("n") if right_need is None else F.col("n") - right_need + 1, on)
    b = b.select(F.col("group").alias("other"), F.col("n").alias("n_other"), "gene", *on, F.col("place").alias("place_other"))
    met = a.select("group", "n", "gene", *on, "place").join(b, ["gene", *on])
    least = need(F.col("n"), F.col("n_other"))
    met = met.where(F.least(F.col("n") - F.col("place"), F.col("n_other") - F.col("place_other")) >= least) if right_need is not None else met.where(F.col("n") - F.col("place") >= least)
    if window is not None:
        met = met.where(window(F.col("n"), F.col("n_other")))
    pairs = met.select("group", "other", "n", "n_other").distinct()
    pairs = pairs.join(left.select("group", "genes"), "group").join(right.select(F.col("group").alias("other"), F.col("genes").alias("others")), "other")
    pairs = pairs.withColumn("shared", F.size(F.array_intersect("genes", "others")))
    return pairs.where(F.col("shared") >= need(F.col("n"), F.col("n_other"))).select("group", "other", "n", "n_other", "shared")


def contained_sets(left: DataFrame, right: DataFrame, share: float = 1.0, on: list[str] | None = None) -> DataFrame:
    """(group, other, n, n_other, shared): pairs where at least the share of the left set lies in the right one."""
    least = F.ceil(F.col("n") * share - 1e-9)
    return similar_sets(left, right, lambda n, _: F.ceil(n * share - 1e-9), least, on=on)


def jaccard_sets(groups: DataFrame, least: float, on: list[str] | None = None) -> DataFrame:
    """(group, other, n, n_other, shared): pairs of different sets, each once, whose shared part of their union is at least `least`."""
    need = lambda n, m: F.ceil((n + m) * (least / (1 + least)) - 1e-9)
    own = F.ceil(F.col("n") * least - 1e-9)
    close = lambda n, m: (m >= n * least - 1e-9) & (n >= m * least - 1e-9)
    return similar_sets(groups, groups, need, own, own, close, on).where("group < other")


def contained_groups(left: DataFrame, right: DataFrame, share: float, strict: bool, on: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs: group, other), (left members: assertion, group, *on), (right members): pairs of distinct gene sets where what the
    left one has beyond the right one is at most (strict: less than) the share of the left set. Members of a pair's groups are
    not paired with each other here."""
    on = on or []
    lm, lg = gene_groups(left, by=on)
    rm, rg = gene_groups(right, by=on)
    # at most m of n genes may be missing
    m = F.ceil(F.col("n") * share - 1e-9) - 1 if strict else F.floor(F.col("n") * share + 1e-9)
    met = similar_sets(lg, rg, lambda n, _: F.lit(0), F.col("n") - F.greatest(m, F.lit(0)), on=on)
    missing = F.col("n") - F.col("shared")
    ok = met.where(missing / F.col("n") < share) if strict else met.where(missing <= share * F.col("n"))
    return ok.select("group", "other"), lm, rm


def contained_pairs(left: DataFrame, right: DataFrame, share: float, strict: bool, on: list[str] | None = None) -> DataFrame:
    """(assertion, other): contained_groups() as pairs of assertions; as many as the groups' sizes multiply to.

    Sides have (assertion, gene, *on); rows with empty sets aren't there, so they make no pairs.
    """
    pairs, lm, rm = contained_groups(left, right, share, strict, on)
    return (
        pairs.join(lm.select("assertion", "group"), "group")
        .join(rm.select(F.col("assertion").alias("other_assertion"), F.col("group").alias("other")), "other")
        .select("assertion", F.col("other_assertion").alias("other")).where("assertion <> other")
    )


#: Residual categories in the order in which they are asked.
CATEGORIES = {
    ("loss", False): ("complete_haploinsufficient", "partial_haploinsufficient", "no_genes", "holds_a_pathogenic_set", "none"),
    ("gain", False): ("complete_triplosensitive", "no_genes", "holds_a_pathogenic_set", "none"),
    ("loss", True): ("no_genes", "within_a_residual_set", "none"),
    ("gain", True): ("no_genes", "within_a_residual_set", "none"),
}


def residual_categories(assertions: DataFrame, sets: DataFrame, hits: DataFrame) -> DataFrame:
    """(assertion, copy_change, direction, category, best): every assertion in exactly one category.

    assertions: (assertion, copy_change, direction); sets: (assertion, gene), the completely overlapped genes; hits:
    (assertion, feature_set, kind) of the dosage map. Assertions that don't support go to the dosage map's category first
    (losses: complete, then partial overlap with haploinsufficient features; gains: complete overlap with triplosensitive
    ones). Of what is left, those that hold all genes of a supporting assertion's set of the same copy change are in conflict
    with it; supporting ones are if all their genes lie in such a residual set. best: the genes of the largest partner set
    that is held, or of the smallest that holds it. Distinct sets are compared, not assertions, by contained_sets().
    """
    own = assertions.select("assertion", "copy_change", "direction", (F.coalesce(F.col("direction") == "Supports", F.lit(False))).alias("supports"))
    flag = lambda s, k: F.max((F.col("feature_set") == s) & (F.col("kind") == k))
    told = hits.groupBy("assertion").agg(flag("haplo", "CompleteOverlap").alias("h"), flag("haplo", "PartialOverlap").alias("p"), flag("triplo", "CompleteOverlap").alias("t"))
    own = own.join(told, "assertion", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    loss, gain = F.col("copy_change") == "loss", F.col("copy_change") == "gain"
    mapped = F.when(~F.col("supports") & loss & yes("h"), "complete_haploinsufficient").when(~F.col("supports") & loss & yes("p"), "partial_haploinsufficient").when(~F.col("supports") & gain & yes("t"), "complete_triplosensitive")
    own = ranges.written(own.select("assertion", "copy_change", "direction", "supports", mapped.alias("mapped")), "categories")
    rest = sets.join(own.where("mapped is null"), "assertion").select("assertion", "gene", "copy_change", "supports")
    members, groups = gene_groups(rest, by=["copy_change", "supports"])
    groups = ranges.written(groups, "residual-sets")
    within = ranges.written(contained_sets(groups.where("supports"), groups.where("not supports"), 1.0, ["copy_change"]), "contained")
    best = within.groupBy(F.col("other").alias("group")).agg(F.max("n").alias("best")).unionByName(within.groupBy("group").agg(F.min("n_other").alias("best")))
    placed = members.join(best, "group", "left").select("assertion", F.lit(True).alias("has_genes"), "best")
    conflict = F.when(F.col("best").isNull(), "none").when(F.col("supports"), "within_a_residual_set").otherwise("holds_a_pathogenic_set")
    category = F.coalesce("mapped", F.when(F.col("has_genes").isNull(), F.lit("no_genes")).otherwise(conflict))
    return own.join(placed, "assertion", "left").select("assertion", "copy_change", "direction", category.alias("category"), F.when(F.col("mapped").isNull(), F.col("best")).cast("long").alias("best"))


def variant_conflicts(assertions: DataFrame, sets: DataFrame, error: float = 0.1, batch: bool = False) -> DataFrame:
    """Supporting assertions against others of the same copy change that are Inconclusive or Refutes (X4; batch: the strict test of X5).

    assertions: (assertion, copy_change, direction); sets: (assertion, gene).
    """
    known = sets.join(assertions, "assertion").select("assertion", "gene", "copy_change", "direction")
    left = known.where("direction = 'Supports'").drop("direction")
    right = known.where("direction in ('Inconclusive', 'Refutes')").drop("direction")
    return contained_pairs(left, right, error, strict=batch, on=["copy_change"])


def symmetric(pairs: DataFrame, predicate: str = "cg:conflictingAssertions") -> DataFrame:
    """Pairs as triples in both directions."""
    a = pairs.select(F.col("assertion").alias("s"), F.lit(predicate).alias("p"), F.col("other").alias("o"))
    return a.unionByName(a.select(F.col("o").alias("s"), "p", F.col("s").alias("o"))).distinct()


def dosage_conflicts(assertions: DataFrame, variants: DataFrame, overlaps: DataFrame, mechanism: DataFrame, annotations: DataFrame, copy_change: str = "loss", mechanism_name: str = "Haploinsufficiency") -> DataFrame:
    """(assertion, mechanisms): variants of the copy change that completely overlap a feature with sufficient evidence, not flagged, not supporting, not of other class, not annotated.

    The exclusions are anti-joins: a missing attribute passes.
    """
    sufficient = mechanism.where((F.col("mechanism") == mechanism_name) & (F.col("strength") == "DosageSufficientEvidence")).select("feature", "mech")
    hit = overlaps.where("kind = 'CompleteOverlap'").join(sufficient, "feature")
    some = assertions.join(variants.where(F.col("copy_change") == copy_change).select("variant"), "variant", "left_semi")
    some = conflicting_assertions(some, annotations)
    return some.join(hit, "variant").groupBy("assertion").agg(F.sort_array(F.collect_set("mech")).alias("mechanisms"))


def conflicting_assertions(assertions: DataFrame, annotations: DataFrame) -> DataFrame:
    """Assertions that may conflict with a dosage map: the exclusions of dosage_conflicts(), a missing attribute passes."""
    some = assertions
    for bad in ("review_status = 'Flagged'", "direction = 'Supports'", "classification = 'OtherClassification'"):
        some = some.join(assertions.where(bad).select("assertion"), "assertion", "left_anti")
    return some.join(annotations.select(F.col("subject").alias("assertion")), "assertion", "left_anti")


def dosage_conflicts_of(assertions: DataFrame, variants: DataFrame, features: DataFrame, mechanism: DataFrame, annotations: DataFrame, copy_change: str = "loss", mechanism_name: str = "Haploinsufficiency") -> DataFrame:
    """dosage_conflicts() of variants and features with one location each: only variants of assertions that may conflict meet
    only features with sufficient evidence, and their pairs are shuffled once, by assertion."""
    sufficient = mechanism.where((F.col("mechanism") == mechanism_name) & (F.col("strength") == "DosageSufficientEvidence")).select("feature", "mech")
    about = conflicting_assertions(assertions, annotations).select("variant", "assertion")
    stated = variants.where(F.col("copy_change") == copy_change).join(about, "variant")
    found = intervals.overlaps(stated, features.join(sufficient, "feature"), key="assertion", fkey="mech", one_location=True)
    return found.where("kind = 'CompleteOverlap'").groupBy("assertion").agg(F.sort_array(F.collect_set("mech")).alias("mechanisms"))


def related_assertions(assertions: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs that share a gene and copy change, differ in direction, the other's set no larger (X9): related_groups() multiplied out."""
    pairs, members = related_groups(assertions, sets)
    members = members.select("assertion", "group")
    return pairs.join(members, "group").join(members.select(F.col("assertion").alias("other_assertion"), F.col("group").alias("other")), "other").select("assertion", F.col("other_assertion").alias("other"))


def conflict_groups(assertions: DataFrame, sets: DataFrame, error: float = 0.1, batch: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """variant_conflicts() as pairs of gene sets (group, other) and the members of either side (assertion, group, copy_change): nothing is multiplied out."""
    known = sets.join(assertions, "assertion").select("assertion", "gene", "copy_change", "direction")
    left = known.where("direction = 'Supports'").drop("direction")
    right = known.where("direction in ('Inconclusive', 'Refutes')").drop("direction")
    return contained_groups(left, right, error, batch, ["copy_change"])


def related_groups(assertions: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """related_assertions() as pairs of gene sets (group, other) of one copy change and different directions, and the members (assertion, group)."""
    members, groups = gene_groups(sets.join(assertions, "assertion"), by=["copy_change", "direction"])
    flat = groups.select("group", "n", "copy_change", "direction", F.explode("genes").alias("gene"))
    other = flat.select(F.col("group").alias("other"), F.col("n").alias("n_other"), "copy_change", F.col("direction").alias("d2"), "gene")
    pairs = flat.join(other, ["gene", "copy_change"]).where("direction <> d2 and n_other <= n").select("group", "other").distinct()
    return pairs, members


def related_counts(assertions: DataFrame, sets: DataFrame, max_subset_genes: int = 10) -> DataFrame:
    """(assertion, n_related): how many assertions related_assertions pairs each with, for all that have genes, without making the pairs.

    A set meets as many others as inclusion and exclusion over its subsets say: subsets of odd size count the others that
    hold them, those of even size count against. The others are no larger, so sets of at most max_subset_genes need the
    subsets of such sets alone; larger sets are joined to the others gene by gene.
    """
    members, groups = gene_groups(sets.join(assertions, "assertion"), by=["copy_change", "direction"])
    weights = members.groupBy("group").agg(F.count("*").alias("weight"))
    groups = groups.join(weights, "group").select("group", "n", "genes", "copy_change", "direction", "weight")
    subsets = F.aggregate("genes", F.array(F.array().cast("array<string>")), lambda acc, g: F.concat(acc, F.transform(acc, lambda s: F.concat(s, F.array(g)))))
    small = groups.where(F.col("n") <= max_subset_genes).withColumn("subset", F.explode(subsets)).where(F.size("subset") > 0)
    held = small.groupBy("subset", "copy_change", F.col("direction").alias("d2"), F.col("n").alias("n_other")).agg(F.sum("weight").alias("weight"))
    sign = F.when(F.size("subset") % 2 == 1, 1).otherwise(-1)
    few = small.drop("weight").join(held, ["subset", "copy_change"]).where("direction <> d2 and n_other <= n").groupBy("group").agg(F.sum(sign * F.col("weight")).alias("n_related"))
    flat = groups.withColumn("gene", F.explode("genes"))
    other = flat.select(F.col("group").alias("other"), F.col("n").alias("n_other"), "copy_change", F.col("direction").alias("d2"), "gene", "weight")
    large = flat.where(F.col("n") > max_subset_genes).drop("weight").join(other, ["gene", "copy_change"]).where("direction <> d2 and n_other <= n")
    many = large.select("group", "other", "weight").distinct().groupBy("group").agg(F.sum("weight").alias("n_related"))
    return members.join(few.unionByName(many), "group", "left").select("assertion", F.coalesce("n_related", F.lit(0)).cast("long").alias("n_related"))


def same_gene_set(regions: DataFrame, variants: DataFrame) -> DataFrame:
    """(region, variant) with equal gene sets (X11). regions: (region, gene); variants: (variant, gene)."""
    r = regions.groupBy("region").agg(F.sort_array(F.collect_set("gene")).alias("genes"))
    v = variants.groupBy("variant").agg(F.sort_array(F.collect_set("gene")).alias("genes"))
    return r.join(v, "genes").select("region", "variant")


def region_matches(regions: DataFrame, variants: DataFrame, slack: float = 0.05, share: float = 0.9) -> DataFrame:
    """(region, variant): the variant's gene count is within round(slack * region's) of the region's, and at least the share of its genes lie in the region.

    Both sizes bound each other, so both sides' prefixes are short, and distinct sets are compared.
    """
    rm, rg = gene_groups(regions, "region")
    vm, vg = gene_groups(variants, "variant")
    window = lambda n: F.floor(n * slack + 0.5)
    # a variant of n genes shares share * n; a region's least partner has n - window genes
    need_variant = F.ceil(F.col("n") * share - 1e-9)
    need_region = F.ceil((F.col("n") - window(F.col("n"))) * share - 1e-9)
    close = lambda n, m: F.abs(n - m) <= window(m)
    met = similar_sets(vg, rg, lambda n, _: F.ceil(n * share - 1e-9), need_variant, need_region, close)
    return met.select("group", "other").join(vm, "group").join(rm.select("region", F.col("group").alias("other")), "other").select("region", "variant")
