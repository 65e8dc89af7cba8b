"""Locations, boundary index, candidate windows and overlap kinds.

A location is six columns: seq_ref, start_outer, start_inner, end_inner, end_outer, is_range; a definite one has equal
outer and inner members. The interval join bins both sides in a hierarchy of bin widths: each row has the width at which
it covers few bins, and a pair meets at the wider of its two widths, so no row, however wide, makes many, and in one bin
only (the later of the two first bins), which needs no distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab

WIDTHS = {"Gene": 500_000, "DosageRegion": 12_000_000}
_LEVELS = [1 << 14, 1 << 17, 1 << 20, 1 << 23, 1 << 26, 1 << 29]


def definite(start: Column | str, end: Column | str) -> list[Column]:
    """The location columns of plain start and end columns."""
    s, e = (F.col(x) if isinstance(x, str) else x for x in (start, end))
    return [s.alias("start_outer"), s.alias("start_inner"), e.alias("end_inner"), e.alias("end_outer"), F.lit(False).alias("is_range")]


def overlap_kind(v: str = "v.", f: str = "f.", mode: str = "compat") -> Column:
    """Kind of overlap of a variant (prefix v) with a feature (prefix f).

    compat: strict comparisons on the inner bounds; null bounds give NoOverlap before outer bounds are looked at.
    strict: the feature inside the variant's inner bounds (ends included) is complete, any other inner intersection
    partial, else an intersection of the outer bounds is outer.
    """
    a, b = (lambda n: F.col(f"{v}{n}")), (lambda n: F.col(f"{f}{n}"))
    a_s, a_e, b_s, b_e = a("start_inner"), a("end_inner"), b("start_inner"), b("end_inner")
    missing = a_s.isNull() | a_e.isNull() | b_s.isNull() | b_e.isNull()
    outer = (a("end_outer") >= b("start_outer")) & (b("end_outer") >= a("start_outer"))
    if mode == "compat":
        kind = F.when(missing, "NoOverlap").when((a_s < b_s) & (b_e < a_e), "CompleteOverlap")
        kind = kind.when(((a_s < b_s) & (b_s < a_e)) | ((b_e < a_e) & (b_s < b_e)), "PartialOverlap")
        return kind.when((a("is_range") | b("is_range")) & F.coalesce(outer, F.lit(False)), "OuterOverlap").otherwise("NoOverlap")
    kind = F.when(~missing & (a_s <= b_s) & (b_e <= a_e), "CompleteOverlap").when(~missing & (a_s <= b_e) & (b_s <= a_e), "PartialOverlap")
    return kind.when(F.coalesce(outer, F.lit(False)), "OuterOverlap").otherwise("NoOverlap")


def feature_bounds(features: DataFrame, key: str = "feature") -> DataFrame:
    """Boundary index: one row per feature, sequence and coordinate."""
    coords = F.array_distinct(F.array_compact(F.array("start_outer", "start_inner", "end_inner", "end_outer")))
    return features.select(key, "ftype", "seq_ref", F.explode(coords).alias("coord")).distinct()


def window_end(ftype: Column, widths: dict[str, int] = WIDTHS) -> Column:
    return F.greatest(F.col("start_outer") + vocab.lookup(widths, ftype, None).cast("long"), F.col("start_outer"), F.coalesce("end_outer", "start_outer"))


def candidates(variants: DataFrame, features: DataFrame, bin_width: int = 1 << 20, key: str = "variant", fkey: str = "feature", widths: dict[str, int] = WIDTHS) -> DataFrame:
    """Pairs with a feature boundary inside [min start, max(min start + width, max end)], both ends included.

    Variants without a start make no candidates.
    """
    # types without a width of their own share one window, so a variant has a row per width, whatever the types
    kind = F.when(F.col("ftype").isin(*widths), F.col("ftype")).otherwise(F.lit(""))
    bounds = feature_bounds(features, fkey).withColumn("kind", F.coalesce(kind, F.lit(""))).withColumn("bin", F.floor(F.col("coord") / bin_width))
    wide = variants.where("start_outer is not null").withColumn("kind", F.explode(F.array(*map(F.lit, [*widths, ""]))))
    wide = wide.withColumn("to", window_end(F.col("kind"), widths)).select(key, "seq_ref", "kind", "start_outer", "to")
    wide = wide.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start_outer") / bin_width), F.floor(F.col("to") / bin_width))))
    return wide.join(bounds, ["seq_ref", "kind", "bin"]).where("coord between start_outer and to").select(key, fkey).distinct()


def _own_level(size: Column) -> Column:
    """The smallest width of which a location covers a few bins only."""
    level = F.lit(_LEVELS[-1])
    for w in reversed(_LEVELS):
        level = F.when(size <= 4 * w, w).otherwise(level)
    return level.cast("long")


def _binned(df: DataFrame, places: Column, start: str, end: str) -> DataFrame:
    """A row per place (level, finer) and bin of that level."""
    rows = df.withColumn("_at", F.explode(places)).withColumns({"level": F.col("_at.level"), "finer": F.col("_at.finer")}).drop("_at")
    return rows.withColumn("bin", F.explode(F.sequence(F.floor(F.col(start) / F.col("level")), F.floor(F.greatest(end, start) / F.col("level")))))


def interval_join(variants: DataFrame, features: DataFrame) -> DataFrame:
    """Rows of both sides (columns prefixed v_ and f_) whose outer extents on one sequence intersect, ends included.

    Each row has the level of its own size, at which it covers six bins at most. A pair meets at the coarser of its two
    levels: a variant at its own level meets features of that level and finer ones, which stand there with a bin or two
    (finer: false), and a feature at its own level meets finer variants in the same way (finer: true). So neither a wide
    variant nor a wide feature makes many rows. Which levels occur is asked of both sides first (six numbers each), and rows
    are made for those alone.
    """
    v = variants.select(*[F.col(c).alias(f"v_{c}") for c in variants.columns]).where("v_start_outer is not null and v_end_outer is not null and v_seq_ref is not null")
    f = features.select(*[F.col(c).alias(f"f_{c}") for c in features.columns]).where("f_start_outer is not null and f_end_outer is not null and f_seq_ref is not null")
    v = v.withColumn("_own", _own_level(F.col("v_end_outer") - F.col("v_start_outer")))
    f = f.withColumn("_own", _own_level(F.col("f_end_outer") - F.col("f_start_outer")))
    of_v, of_f = (sorted(r[0] for r in df.select("_own").distinct().collect()) or _LEVELS[-1:] for df in (v, f))
    place = lambda level, finer: F.struct(level.cast("long").alias("level"), F.lit(finer).alias("finer"))
    own = F.col("_own")
    coarser = [F.when(F.lit(w) > own, place(F.lit(w), True)) for w in of_f if w > of_v[0]]
    v = _binned(v, F.array_compact(F.array(place(own, False), *coarser)), "v_start_outer", "v_end_outer")
    met_by = [F.when(F.lit(w) >= own, place(F.lit(w), False)) for w in of_v]
    alone = [place(own, True)] if of_f[-1] > of_v[0] else []
    f = _binned(f, F.array_compact(F.array(*met_by, *alone)), "f_start_outer", "f_end_outer")
    v, f = v.drop("_own").withColumnRenamed("v_seq_ref", "seq_ref"), f.drop("_own").withColumnRenamed("f_seq_ref", "seq_ref")
    met = v.join(f, ["seq_ref", "level", "finer", "bin"]).where("v_start_outer <= f_end_outer and f_start_outer <= v_end_outer")
    return met.where("bin = greatest(floor(v_start_outer / level), floor(f_start_outer / level))").drop("level", "finer", "bin")


def overlaps(variants: DataFrame, features: DataFrame, mode: str = "compat", key: str = "variant", fkey: str = "feature", widths: dict[str, int] = WIDTHS, one_location: bool = False) -> DataFrame:
    """(variant, feature, kind): the best kind of each pair over all sequences, NoOverlap left out.

    Sides may have several location rows per key, one per build; one_location says that no key has more than one on
    either side, so that a pair meets once and the pairs need no shuffle to find their best kind. In compat mode a pair also needs a feature boundary in
    the variant's candidate window on some sequence; on a single sequence every kind but NoOverlap implies that
    the outer extents meet, so the interval join loses none of them.
    """
    met = interval_join(variants, features)
    if mode == "compat":
        to = F.greatest(F.col("v_start_outer") + F.coalesce(vocab.lookup(widths, F.col("f_ftype")).cast("long"), F.lit(0)), F.col("v_end_outer"))
        inside = [F.col(c).between(F.col("v_start_outer"), to) for c in ("f_start_outer", "f_start_inner", "f_end_inner", "f_end_outer")]
        met = met.where(F.coalesce(inside[0], F.lit(False)) | F.coalesce(inside[1], F.lit(False)) | F.coalesce(inside[2], F.lit(False)) | F.coalesce(inside[3], F.lit(False)))
    kind = overlap_kind("v_", "f_", mode)
    rank = vocab.lookup({k: i for i, k in enumerate(vocab.OVERLAP_ORDER)}, kind)
    best = met.select(F.col(f"v_{key}").alias(key), F.col(f"f_{fkey}").alias(fkey), rank.alias("rank")).where(F.col("rank") < 3)
    if not one_location:
        best = best.groupBy(key, fkey).agg(F.min("rank").alias("rank"))
    return best.select(key, fkey, F.element_at(F.array(*map(F.lit, vocab.OVERLAP_ORDER)), F.col("rank") + 1).alias("kind"))


def coding_overlaps(variants: DataFrame, features: DataFrame, mode: str = "compat", one_location: bool = False) -> DataFrame:
    """Overlaps with protein-coding features alone."""
    return overlaps(variants, features.where("protein_coding"), mode, one_location=one_location)


def gene_count_criteria(found: DataFrame, key: str = "variant") -> DataFrame:
    """(variant, criterion): Genes25, 35 and 50 by the number of completely overlapped features (A3)."""
    return criteria_of_counts(found.where("kind = 'CompleteOverlap'").groupBy(key).count(), key)


def criteria_of_counts(counts: DataFrame, key: str = "variant") -> DataFrame:
    """The same from (variant, count)."""
    met = F.array_compact(F.array(*[F.when(F.col("count") >= n, name) for n, name in vocab.GENE_COUNT_CRITERIA.items()]))
    return counts.select(key, F.explode(met).alias("criterion"))
