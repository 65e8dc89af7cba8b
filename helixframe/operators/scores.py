"""Loss-of-function scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import log_odds
from .overlap_sums import overlap_sums


def lof_scores(overlaps: DataFrame, lof: DataFrame, key: str = "variant") -> DataFrame:
    """(variant, score): log-odds of the product of 1 - s over completely overlapped genes that have a score; others are left out."""
    hit = overlaps.where("kind = 'CompleteOverlap'").join(lof.withColumnRenamed("gene", "feature"), "feature")
    none = hit.groupBy(key).agg(F.product(1 - F.col("lower95")).alias("none"))
    return none.select(key, log_odds("none").alias("score"))


#: Logarithms are added as whole numbers in two parts, so that sums are exact and don't depend on their order.
_HIGH, _LOW = float(1 << 20), float(1 << 30)


def lof_scores_of(variants: DataFrame, features: DataFrame, lof: DataFrame, key: str = "variant") -> DataFrame:
    """lof_scores() of variants with one location over features with one, from sums of logarithms per variant: no pairs are made.

    Factors of zero and below are counted, as they have no logarithm; a product too small for a double is 0, as that of
    the factors is.
    """
    factor = 1 - F.col("lower95").cast("double")
    odd = F.isnan(factor) | (F.abs(factor) == float("inf"))
    usual = factor.isNotNull() & ~odd & (factor != 0)
    log = F.when(usual, F.log(F.abs(factor)) * _HIGH)
    parts = lof.select(F.col("gene").alias("feature"), F.round(log).cast("long").alias("high"), F.round((log - F.round(log)) * _LOW).cast("long").alias("low"), factor.alias("factor"), F.coalesce(odd, F.lit(False)).alias("odd"))
    sums = {"high": F.sum("high"), "low": F.sum("low"), "rows": F.count("*"), "known": F.count("factor"), "odd": F.count_if("odd"), "zero": F.count_if(F.col("factor") == 0), "minus": F.count_if(F.col("factor") < 0)}
    terms = features.join(parts.groupBy("feature").agg(*[c.alias(n) for n, c in sums.items()]), "feature")
    met = overlap_sums(variants, terms, {n: F.col(n) for n in sums}, ["CompleteOverlap"], key)
    n = lambda c: F.col(f"{c}_CompleteOverlap")
    product = F.exp((n("high") + n("low") / _LOW) / _HIGH) * F.when(n("minus") % 2 == 0, 1.0).otherwise(-1.0)
    none = F.when(n("odd") > 0, F.lit(float("nan"))).when(n("zero") > 0, 0.0).when(n("known") > 0, product)
    return met.where(n("rows") > 0).select(key, none.alias("none")).select(key, log_odds("none").alias("score"))


def gene_table(lof: DataFrame, features: DataFrame, mechanism: DataFrame, validity: DataFrame) -> DataFrame:
    """Symbol, score, haploinsufficiency strength and inheritance lists per scored gene."""
    haplo = mechanism.where("mechanism = 'Haploinsufficiency'").groupBy(F.col("feature").alias("gene")).agg(F.min("strength").alias("haplo"))
    modes = validity.groupBy("gene").agg(F.array_join(F.sort_array(F.collect_set("moi")), ",").alias("moi"))
    names = features.select(F.col("feature").alias("gene"), "symbol")
    return lof.join(names, "gene", "left").join(haplo, "gene", "left").join(modes, "gene", "left").select("gene", "symbol", F.col("lower95").alias("score"), "haplo", "moi")
