import pytest
from pyspark.sql import functions as F

from helixframe.functions import scalars as S
from helixframe.functions import vocab


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("text,want", [
    ("arr[hg19] 5p15.2(11,397,258-11,419,020 )x1 mat", [("hg19", "5", "p15.2", 11397258, 11419020, 1, "mat")]),
    ("arr[hg19] Xp22.13(17,674,125-17,991,059)x2 mat", [("hg19", "X", "p22.13", 17674125, 17991059, 2, "mat")]),
    ("arr[GRCh37] 17p13.3(525-775,054)x1 dn, 2q14.2(120502945_121236771)x4[0.4] pat", [("GRCh37", "17", "p13.3", 525, 775054, 1, "dn"), (None, "2", "q14.2", 120502945, 121236771, 4, "pat")]),
    ("no variant here", []),
])
def test_iscn(spark, text, want):
    assert [tuple(v) for v in one(spark, S.iscn_variants("c"), c=text)] == want


def test_curies_go_both_ways(spark):
    iri = one(spark, S.curie_to_iri("c"), c="MONDO:0001")
    assert iri == vocab.PREFIXES["mondo"] + "0001"
    assert one(spark, S.iri_to_curie("c"), c=iri) == "mondo:0001"
    assert one(spark, S.curie_to_iri("c"), c="unknown:1") == "unknown:1"
    assert one(spark, S.keyword_to_iri("c"), c=":cg/Gene") == vocab.PREFIXES["cg"] + "Gene"


@pytest.mark.parametrize("raw,want", [("hgnc:123", "HGNC:123"), ("HGNC:5", "HGNC:5"), ("99999", "99999"), ("hgnc:123456", "hgnc:123456"), ("x", "x")])
def test_hgnc(spark, raw, want):
    assert one(spark, S.normal_hgnc("c"), c=raw) == want


@pytest.mark.parametrize("build", ["hg19", "GRCh37", "19", "hg38", "grch38", "38"])
def test_refseq_of_all_chromosomes(spark, build):
    rows = spark.createDataFrame([(c,) for c in vocab.CHROMOSOMES], "c string").select("c", S.refseq("c", F.lit(build)).alias("a"), S.refseq(F.concat(F.lit("chr"), "c"), F.lit(build)).alias("b")).collect()
    assert all(r["a"] == r["b"] and r["a"].startswith("https://identifiers.org/refseq:NC_0000") for r in rows)
    assert len({r["a"] for r in rows}) == 24


def test_unknown_chromosome_or_build_is_null(spark):
    assert one(spark, S.refseq("c", F.lit("hg17")), c="1") is None
    assert one(spark, S.refseq("c", F.lit("hg19")), c="chrZZ") is None


def test_log_odds_has_infinities(spark):
    assert one(spark, S.log_odds("p"), p=0.0) == float("inf")
    assert one(spark, S.log_odds("p"), p=1.0) == float("-inf")
    assert one(spark, S.log_odds("p"), p=0.5) == 0.0


def test_attributes(spark):
    assert one(spark, S.attributes("c"), c="END=5;FLAG;A=x=y;END=6;") == {"FLAG": "true", "A": "x=y", "END": "6"}


def test_parsing(spark):
    assert one(spark, S.double_or("c"), c="none") == -1.0
    assert one(spark, S.long_or_null("c"), c="1.5x") is None
    assert one(spark, S.digits("c"), c="chr1: 12,345") == 112345
    assert tuple(one(spark, S.locus_parts("c"), c="chr16:100,000–200,000")) == ("chr16", 100000, 200000)
    assert str(one(spark, S.offset_instant("c"), c="2018-03-27T09:55:41.000-0400")) == "2018-03-27 13:55:41"
    assert one(spark, S.hpo_iri("c"), c="Autosomal (HP:0000006)") == vocab.PREFIXES["hp"] + "0000006"


def test_content_ids_depend_on_attributes_alone(spark):
    a = one(spark, S.content_id("T", x="a", y="b"), a="1", b="2")
    assert a == one(spark, S.content_id("T", y="b", x="a"), a="1", b="2") != one(spark, S.content_id("T", x="a", y="b"), a="1", b="3")
