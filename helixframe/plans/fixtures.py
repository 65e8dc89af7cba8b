"""Queries of readers, builders and writers: source files are written from the shared tables, read by the library's readers and built into tables.

Files go to the shared folder, many records to a file where the format is one document per file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import vocab
from ..operators import builders, filters
from ..sources import files, sinks
from .registry import Source, query

K = "p_partkey"


def text_file(df: DataFrame, what: str, gz: bool = False) -> str:
    """The folder of a text file written from the one column of df."""
    path = sinks.shared_folder(df.sparkSession, what)
    df.write.option("compression", "gzip" if gz else "none").text(path)
    return path


def csv_file(df: DataFrame, what: str, sep: str = ",") -> str:
    path = sinks.shared_folder(df.sparkSession, what)
    df.write.csv(path, header=True, sep=sep, escape='"')
    return path


def documents_of(df: DataFrame, doc: Column, what: str, number: Column) -> str:
    """A folder with one document per file, each of a thousand numbers' rows."""
    path = sinks.shared_folder(df.sparkSession, what)
    df.groupBy(F.floor(number / 1000).alias("_part")).agg(doc.alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)
    return path


def tabbed(*columns: Column | str) -> Column:
    return F.concat_ws("\t", *columns)


def text_of(key: str = K, before: str = "", after: str = "") -> Column:
    return F.concat(F.lit(before), F.col(key).cast("string"), F.lit(after))


# ---- genes, features, bands --------------------------------------------------------------------------------------


def genes(t: Source) -> DataFrame:
    k = F.col(K)
    kinds = F.when(k % 3 == 0, "pseudogene").when(k % 3 == 1, "gene with protein product").otherwise("a kind of its own")
    fields = F.struct(
        text_of(before="HGNC:").alias("hgnc_id"), text_of(before="G").alias("symbol"), F.col("p_name").alias("name"), F.when(k % 10 != 0, k.cast("string")).alias("entrez_id"),
        text_of(before="ENSG").alias("ensembl_gene_id"), kinds.alias("locus_type"), F.concat((k % 22 + 1).cast("string"), F.lit("p")).alias("location"), F.array("p_brand").alias("alias_symbol"),
    )
    return files.load_genes(t.spark, documents_of(t.part, F.to_json(F.struct(F.struct(F.collect_list(fields).alias("docs")).alias("response"))), "genes", k))


query("s5_genes", """SELECT concat('HGNC:', p_partkey) AS hgnc_id, concat('G', p_partkey) AS symbol, p_name AS name, CASE WHEN p_partkey % 10 <> 0 THEN CAST(p_partkey AS VARCHAR) END AS entrez_id,
concat(p_partkey % 22 + 1, 'p') AS location, p_brand AS alias FROM part""")(
    lambda t: genes(t).select("hgnc_id", "symbol", "name", "entrez_id", "location", F.col("alias_symbol")[0].alias("alias"))
)
_GENE = "SELECT concat('https://identifiers.org/ncbigene:', p_partkey) AS s, {p} AS p, {o} AS o FROM part WHERE p_partkey % 10 <> 0{w}"
query("b8_gene_triples", " UNION ".join(_GENE.format(p=f"'{p}'", o=o, w=w) for p, o, w in (
    ("skos:prefLabel", "concat('G', p_partkey)", ""), ("skos:altLabel", "p_name", ""), ("owl:sameAs", "concat('hgnc:', p_partkey)", ""), ("owl:sameAs", "concat('ensembl:ENSG', p_partkey)", ""),
    ("owl:sameAs", "concat('ncbigene:', p_partkey)", ""), ("rdf:type", "'so:Gene'", ""), ("rdf:type", "CASE p_partkey % 3 WHEN 0 THEN 'so:0000336' ELSE 'so:0001217' END", " AND p_partkey % 3 <> 2"),
    ("so:ChromosomeBand", "concat(p_partkey % 22 + 1, 'p')", ""), ("skos:hiddenLabel", "p_brand", ""),
)))(lambda t: builders.gene_triples(genes(t)).select("s", "p", "o"))
query("b21_hgnc_map", "SELECT concat('HGNC:', p_partkey) AS hgnc, concat('https://identifiers.org/ncbigene:', p_partkey) AS entrez FROM part WHERE p_partkey % 10 <> 0")(lambda t: builders.hgnc_map(builders.gene_triples(genes(t))))


def gff(t: Source) -> DataFrame:
    k = F.col(K)
    kinds = F.when(k % 4 == 0, "exon").when(k % 4 == 1, "mRNA").otherwise("gene")
    attrs = F.concat(F.lit("ID=f"), K, F.lit(";Dbxref=GeneID:"), (k % 50).cast("string"), F.lit(",X:1;Name=N"), (k % 50).cast("string"), F.lit(";flag"))
    line = tabbed(F.concat(F.lit("NC_"), (k % 5).cast("string")), F.lit("R"), kinds, k.cast("string"), (k + 100).cast("string"), F.lit("."), F.lit("+"), F.lit("."), attrs)
    return files.load_gff(t.spark, text_file(t.part.select(F.explode(F.array(line, F.lit("#comment"), F.lit("NC_0\tR\tgene")))), "gff", gz=True))


query("s3_gff", """SELECT concat('NC_', p_partkey % 5) AS seqid, CASE WHEN p_partkey % 4 = 0 THEN 'so:Exon' ELSE 'so:Gene' END AS so_type, CAST(p_partkey AS BIGINT) AS start, CAST(p_partkey + 100 AS BIGINT) AS "end",
concat('f', p_partkey) AS id, CAST(p_partkey % 50 AS VARCHAR) AS gene_id, 'true' AS flag FROM part WHERE p_partkey % 4 <> 1""")(
    lambda t: gff(t).select("seqid", "so_type", "start", "end", "id", "gene_id", F.col("attrs")["flag"].alias("flag"))
)
query("k7_merged_locations", """SELECT concat('https://identifiers.org/ncbigene:', p_partkey % 50) AS iri, concat('N', p_partkey % 50) AS symbol, count(*) AS n_locations, CAST(min(p_partkey) AS BIGINT) AS least
FROM part WHERE p_partkey % 4 >= 2 GROUP BY p_partkey % 50""")(
    lambda t: files.gene_features(gff(t)).select("iri", "symbol", F.size("locations").cast("long").alias("n_locations"), F.array_min(F.transform("locations", lambda x: x["start"])).alias("least"))
)
_CHROM = "CASE WHEN p_partkey % 25 = 0 THEN 'Un' WHEN p_partkey % 25 = 23 THEN 'X' WHEN p_partkey % 25 = 24 THEN 'Y' ELSE CAST(p_partkey % 25 AS VARCHAR) END"


def chrom(key: str = K) -> Column:
    n = F.col(key) % 25
    return F.when(n == 0, "Un").when(n == 23, "X").when(n == 24, "Y").otherwise(n.cast("string"))


query("s12_cytobands", f"SELECT concat({_CHROM}, 'q', p_partkey) AS band, CAST(p_partkey AS BIGINT) AS start, CAST(p_partkey + p_size AS BIGINT) AS \"end\", p_partkey % 25 AS number FROM part WHERE p_partkey % 25 <> 0")(
    lambda t: files.load_cytobands(t.spark, text_file(t.part.select(tabbed(F.concat(F.lit("chr"), chrom()), text_of(), (F.col(K) + F.col("p_size")).cast("string"), text_of(before="q"), F.lit("gneg"))), "bands", gz=True), "hg19")
    .select("band", "start", "end", F.regexp_extract("seq_ref", r"NC_0*(\d+)\.", 1).cast("int").alias("number"))
)
query("s13_ncbi_features", """SELECT concat('NC_', p_partkey % 5) AS seqid, CAST(p_partkey AS BIGINT) AS start, CAST(p_partkey + p_size AS BIGINT) AS "end", concat('G', p_partkey) AS symbol, CAST(p_partkey AS VARCHAR) AS gene_id FROM part WHERE p_partkey % 3 <> 0""")(
    lambda t: files.load_ncbi_features(t.spark, text_file(t.part.select(tabbed(
        F.when(F.col(K) % 3 != 0, "gene").otherwise("mRNA"), *[F.lit("x")] * 5, F.concat(F.lit("NC_"), (F.col(K) % 5).cast("string")), text_of(after="~"), (F.col(K) + F.col("p_size")).cast("string"), F.lit("+"), *[F.lit("y")] * 4, text_of(before="G"), text_of(),
    )), "ncbi", gz=True)).select("seqid", "start", "end", "symbol", "gene_id")
)

# ---- VCF ---------------------------------------------------------------------------------------------------------


def vcf(t: Source) -> DataFrame:
    k = F.col("o_orderkey")
    kind = F.when(k % 3 == 0, "DEL").when(k % 3 == 1, "DUP").otherwise("INV")
    info = F.concat(F.lit("END="), (k + 2000).cast("string"), F.lit(";SVTYPE="), kind, F.lit(";SVLEN="), (k % 3000).cast("string"), F.lit(";AC="), (k % 7).cast("string"), F.when(k % 2 == 0, ";PREDICTED_LOF=G1").otherwise(""), F.lit(";NOT_ASKED=1"))
    line = tabbed(F.concat(F.lit("chr"), chrom("o_orderkey")), k.cast("string"), text_of("o_orderkey", "sv"), F.lit("N"), F.concat(F.lit("<"), kind, F.lit(">")), F.lit("9"), F.when(k % 5 == 0, "LOW").otherwise("PASS"), info)
    return files.load_vcf(t.spark, text_file(t.orders.select(line), "vcf", gz=True))


_KIND = "CASE o_orderkey % 3 WHEN 0 THEN 'DEL' WHEN 1 THEN 'DUP' ELSE 'INV' END"
query("s4_vcf", f"""SELECT CAST(o_orderkey AS BIGINT) AS pos, {_KIND} AS svtype, CAST(o_orderkey + 2000 AS VARCHAR) AS "end", CAST(o_orderkey % 3000 AS VARCHAR) AS svlen, CAST(o_orderkey % 7 AS VARCHAR) AS ac,
CASE WHEN o_orderkey % 2 = 0 THEN 'G1' END AS predicted_lof, NULL AS chr2, 34 AS n_columns FROM orders""")(
    lambda t: (lambda v: v.select("pos", "svtype", "end", "svlen", "ac", "predicted_lof", "chr2", F.lit(len(v.columns)).alias("n_columns")))(vcf(t))
)
query("f19_lof_deletions", "SELECT CAST(o_orderkey AS BIGINT) AS pos FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 3000 > 1000 AND o_orderkey % 2 = 0")(lambda t: vcf(t).where(filters.is_lof_deletion()).select("pos"))
_REASON = "concat_ws(',', CASE WHEN o_orderkey % 25 = 0 THEN 'unknown chromosome' END, CASE WHEN o_orderkey % 3 = 2 THEN 'unknown variant type' END)"
query("b17_vcf_variants", "SELECT concat('sv', o_orderkey) AS id, CAST(o_orderkey AS BIGINT) AS start_outer, CAST(o_orderkey + 2000 AS BIGINT) AS end_outer, CASE o_orderkey % 3 WHEN 0 THEN 'efo:copy-number-loss' ELSE 'efo:copy-number-gain' END AS copy_change FROM orders WHERE o_orderkey % 25 <> 0 AND o_orderkey % 3 <> 2")(
    lambda t: builders.build_variants(builders.describe_vcf(vcf(t)))[0].select("id", "start_outer", "end_outer", "copy_change")
)
query("x12_vcf_rejects", f"SELECT concat('sv', o_orderkey) AS id, {_REASON} AS reasons FROM orders WHERE o_orderkey % 25 = 0 OR o_orderkey % 3 = 2")(
    lambda t: builders.build_variants(builders.describe_vcf(vcf(t)))[1].select("id", F.array_join("reasons", ",").alias("reasons"))
)
query("s23_info_dictionary", "SELECT concat('N', c_custkey) AS id, c_name AS description FROM customer")(
    lambda t: files.vcf_info_dictionary(t.spark, text_file(t.customer.select(F.explode(F.array(F.concat(F.lit("##INFO=<ID=N"), "c_custkey", F.lit(',Number=1,Type=String,Description="'), "c_name", F.lit('">')), F.lit("##FORMAT=<ID=GT>")))), "vcf-head"))
)


def described(t: Source) -> DataFrame:
    """Variant descriptions with ranges, equal and missing bounds, reversed and negative coordinates."""
    k = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    text = lambda c: c.cast("string")
    case = k % 9
    none = F.lit(None).cast("string")
    return t.lineitem.select(
        k.cast("long").alias("k"), F.when(case == 8, "hg17").when(k % 2 == 0, "hg19").otherwise("GRCh38").alias("build"), F.lit("chr7").alias("chrom"),
        F.when(case.isin(0, 3, 4, 6, 8), text(k)).when(case == 5, "-4").alias("start"), F.when(case.isin(1, 2), text(k)).alias("start_min"), F.when(case == 1, text(k + 5)).when(case == 2, text(k)).alias("start_max"),
        F.when(case.isin(0, 5, 6, 8), text(k + 500)).when(case == 3, text(k - 1)).alias("end"), F.when(case.isin(1, 2), text(k + 400)).alias("end_min"), F.when(case == 1, text(k + 450)).when(case == 2, text(k + 400)).alias("end_max"),
        F.when(case == 6, none).otherwise("DEL").alias("svtype"),
    )


_DESCRIBED = "WITH d AS (SELECT l_orderkey * 10 + l_linenumber AS k FROM lineitem) "
query("b16_ranged_variants", _DESCRIBED + """SELECT CAST(k AS BIGINT) AS k, CAST(k AS BIGINT) AS start_outer, CAST(CASE k % 9 WHEN 1 THEN k + 5 ELSE k END AS BIGINT) AS start_inner,
CAST(CASE k % 9 WHEN 0 THEN k + 500 ELSE k + 400 END AS BIGINT) AS end_inner, CAST(CASE k % 9 WHEN 0 THEN k + 500 WHEN 1 THEN k + 450 ELSE k + 400 END AS BIGINT) AS end_outer, k % 9 = 1 AS is_range FROM d WHERE k % 9 IN (0, 1, 2)""")(
    lambda t: builders.build_variants(described(t))[0].select("k", "start_outer", "start_inner", "end_inner", "end_outer", "is_range")
)
query("x12_ranged_rejects", _DESCRIBED + """SELECT CAST(k AS BIGINT) AS k, CASE k % 9 WHEN 3 THEN 'coordinates reversed' WHEN 4 THEN 'no end' WHEN 5 THEN 'bad start' WHEN 6 THEN 'unknown variant type' WHEN 7 THEN 'no start,no end' ELSE 'unknown build' END AS reasons
FROM d WHERE k % 9 NOT IN (0, 1, 2)""")(lambda t: builders.build_variants(described(t))[1].select("k", F.array_join("reasons", ",").alias("reasons")))

# ---- archive records ---------------------------------------------------------------------------------------------

_TYPES = ["Deletion", "copy number gain", "single nucleotide variant"]
_CLASSES = ["Pathogenic", "Likely benign", "Uncertain significance", "risk factor"]


def pick(values: list[str], n: Column) -> Column:
    return F.array(*map(F.lit, values))[n.cast("int")]


def archive(t: Source) -> DataFrame:
    k = F.col("o_orderkey")
    s = lambda c: c.cast("string")
    attr = lambda name, c: F.concat(F.lit(f' {name}="'), s(c), F.lit('"'))
    place = F.when(k % 2 == 0, F.concat(attr("outerStart", k), attr("innerStart", k + 10), attr("stop", k + 900))).otherwise(F.concat(attr("display_start", k), attr("display_stop", k + 900)))
    location = F.concat(F.lit('<Location><SequenceLocation Assembly="GRCh38" Accession="NC_7"'), place, F.lit("/></Location>"))
    hgvs = F.concat(F.lit("<HGVSlist><HGVS><NucleotideExpression><Expression>h"), s(k), F.lit("</Expression></NucleotideExpression></HGVS></HGVSlist>"))
    allele = F.concat(F.lit("<SimpleAllele"), attr("AlleleID", k), attr("VariationID", k), F.lit("><VariantType>"), pick(_TYPES, k % 3), F.lit("</VariantType><Name>n"), s(k), F.lit("</Name>"), location, hgvs, F.lit("</SimpleAllele>"))
    accession = F.concat(F.lit("<ClinVarAccession"), attr("Accession", F.concat(F.lit("SCV"), s(k))), attr("Version", k % 4), attr("DateUpdated", F.date_format("o_orderdate", "yyyy-MM-dd")), attr("OrgID", F.col("o_custkey")), F.lit("/>"))
    classified = F.concat(
        F.lit("<Classification"), F.when(k % 5 != 0, attr("DateLastEvaluated", F.date_format("o_orderdate", "yyyy-MM-dd"))).otherwise(""), F.lit("><ReviewStatus>"), F.when(k % 11 == 0, "flagged submission").otherwise("criteria provided, single submitter"),
        F.lit("</ReviewStatus><GermlineClassification>"), pick(_CLASSES, k % 4), F.lit("</GermlineClassification></Classification>"),
    )
    origin = F.concat(F.lit("<ObservedInList><ObservedIn><Sample><Origin>"), F.when(k % 2 == 0, "maternal").otherwise("germline"), F.lit("</Origin></Sample></ObservedIn></ObservedInList>"))
    claims = F.concat(F.lit("<ClinicalAssertionList><ClinicalAssertion>"), accession, classified, origin, F.lit("</ClinicalAssertion></ClinicalAssertionList>"))
    record = F.concat(F.lit("<VariationArchive"), attr("Accession", F.concat(F.lit("VCV"), s(k))), attr("Version", k % 3), F.lit("><ClassifiedRecord>"), F.when(k % 13 != 0, allele).otherwise(""), claims, F.lit("</ClassifiedRecord></VariationArchive>"))
    whole = F.concat(F.lit("<Release>"), F.array_join(F.collect_list(record), "\n"), F.lit("</Release>"))
    return files.load_archive(t.spark, documents_of(t.orders, whole, "archive", k))


_AR = "FROM orders WHERE o_orderkey % 13 <> 0"
_VAR = "concat('https://identifiers.org/clinvar:', o_orderkey)"
query("s1_archive", """SELECT concat('VCV', o_orderkey) AS vcv_id, CAST(o_orderkey % 3 AS VARCHAR) AS vcv_version, CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderkey AS VARCHAR) END AS variation_id,
concat('SCV', o_orderkey) AS scv, CASE WHEN o_orderkey % 5 <> 0 THEN strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') END AS evaluated FROM orders""")(
    lambda t: archive(t).select("vcv_id", "vcv_version", "variation_id", F.col("classifications")[0]["accession"].alias("scv"), F.col("classifications")[0]["DateLastEvaluated"].alias("evaluated"))
)
query("b1_archive_variants", f"SELECT {_VAR} AS variant, concat('n', o_orderkey) AS label, CASE o_orderkey % 3 WHEN 0 THEN 'efo:copy-number-loss' WHEN 1 THEN 'efo:copy-number-gain' END AS copy_change {_AR}")(
    lambda t: builders.archive_variants(archive(t)).select("variant", "label", "copy_change")
)
query("b2_archive_locations", f"""SELECT {_VAR} AS variant, 'https://identifiers.org/refseq:NC_7' AS seq_ref, CAST(o_orderkey AS BIGINT) AS start_outer, CAST(o_orderkey + CASE WHEN o_orderkey % 2 = 0 THEN 10 ELSE 0 END AS BIGINT) AS start_inner,
CAST(o_orderkey + 900 AS BIGINT) AS end_inner, CAST(o_orderkey + 900 AS BIGINT) AS end_outer, o_orderkey % 2 = 0 AS is_range {_AR}""")(lambda t: builders.variant_locations(builders.archive_variants(archive(t))).drop("copy_change"))
query("b3_allele_expressions", f"SELECT {_VAR} AS variant, 'HGVS' AS syntax, concat('h', o_orderkey) AS value {_AR}")(
    lambda t: builders.archive_variants(archive(t)).select("variant", F.explode("included").alias("i")).select("variant", F.explode("i.expressions").alias("e")).select("variant", "e.syntax", "e.value")
)
_LABEL = "CASE o_orderkey % 4 WHEN 0 THEN 'cg:Pathogenic' WHEN 1 THEN 'cg:LikelyBenign' WHEN 2 THEN 'cg:UncertainSignificance' ELSE 'cg:OtherClassification' END"
query("b1_archive_assertions", f"""SELECT concat('https://identifiers.org/clinvar.submission:SCV', o_orderkey) AS assertion, {_LABEL} AS classification, CASE o_orderkey % 4 WHEN 0 THEN 'cg:Supports' WHEN 1 THEN 'cg:Refutes' ELSE 'cg:Inconclusive' END AS direction,
CASE WHEN o_orderkey % 11 = 0 THEN 'cg:Flagged' ELSE 'cg:CriteriaProvided' END AS review_status, CASE WHEN o_orderkey % 2 = 0 THEN 'cg:MaternalInheritance' ELSE 'cg:UnknownInheritance' END AS inheritance, concat('https://identifiers.org/clinvar.submitter:', o_custkey) AS submitter {_AR}""")(
    lambda t: builders.archive_assertions(archive(t)).select("assertion", "classification", "direction", "review_status", "inheritance", "submitter")
)
query("b4_contributions", f"""SELECT o_orderkey AS k, 'cg:Submitter' AS role {_AR} UNION ALL SELECT o_orderkey, 'cg:Evaluator' {_AR} AND o_orderkey % 5 <> 0""")(
    lambda t: builders.archive_assertions(archive(t)).select(S.id_tail("assertion", r"\d+$").cast(dict(t.orders.dtypes)["o_orderkey"]).alias("k"), F.explode("contributions").alias("c")).select("k", "c.role")
)
query("b5_proposition_objects", f"""SELECT count(*) AS n, count(DISTINCT o_orderkey) AS n_propositions, (SELECT count(*) {_AR}) AS n_matched {_AR}""")(
    lambda t: (lambda r: builders.archive_propositions(builders.archive_variants(r)).join(builders.archive_assertions(r).select("proposition", "assertion"), "proposition").agg(F.count("*").alias("n"), F.countDistinct("proposition").alias("n_propositions"), F.countDistinct("assertion").alias("n_matched")))(archive(t))
)
query("s2_split_records", "SELECT concat('<gene id=\"', p_partkey, '\"><name>', p_name, '</name></gene>') AS record FROM part")(
    lambda t: files.split_records(t.spark, text_file(t.part.select(F.concat(F.lit('<other/><gene id="'), K, F.lit('"><name>'), "p_name", F.lit("</name></gene>\n<genes>x</genes>"))), "records"), "gene")
)

# ---- validity, affiliations, reports, scores ---------------------------------------------------------------------


def gencc(t: Source) -> DataFrame:
    k = F.col(K)
    columns = {
        "uuid": text_of(), "gene_curie": text_of(before=" HGNC:"), "disease_original_curie": text_of(before="mondo:"), "classification_curie": F.concat(F.lit("GENCC:10000"), (k % 6 + 1).cast("string")),
        "moi_curie": F.lit("HP:0000006"), "submitter_curie": F.concat(F.lit("GENCC:0001"), F.lpad((k % 14 + 1).cast("string"), 2, "0")), "submitter_title": F.lit('a "quoted", title'),
        "submitted_as_date": F.lit("2020-02-03 11:22"), "submitted_run_date": F.lit("2021-01-01"),
    }
    return files.load_gencc(t.spark, csv_file(t.part.select(*[c.alias(n) for n, c in columns.items()]), "gencc"))


_STRENGTH = "CASE p_partkey % 6 WHEN 0 THEN 'cg:Definitive' WHEN 1 THEN 'cg:Strong' WHEN 2 THEN 'cg:Moderate' WHEN 3 THEN 'cg:Limited' WHEN 4 THEN 'cg:Disputed' ELSE 'cg:Refuted' END"
_SUBMITTER = "concat('GENCC:0001', lpad(CAST(p_partkey % 14 + 1 AS VARCHAR), 2, '0'))"
query("s6_gencc", f"SELECT CAST(p_partkey AS VARCHAR) AS uuid, concat(' HGNC:', p_partkey) AS gene_curie, {_SUBMITTER} AS submitter_curie FROM part WHERE p_partkey % 14 <> 1")(
    lambda t: gencc(t).select("uuid", F.concat(F.lit(" "), F.trim("gene_curie")).alias("gene_curie"), "submitter_curie")
)


def validity(t: Source) -> tuple[DataFrame, DataFrame]:
    return builders.shared_validity(gencc(t), t.part.where(f"{K} % 3 <> 0").select(text_of(before="HGNC:").alias("hgnc"), text_of(before="ncbigene:").alias("entrez")))


query("b7_shared_validity", f"""SELECT {_STRENGTH} AS strength, concat('https://curation.example.org/r/gencc/', substr({_SUBMITTER}, 7)) AS agent, '2020-02-03' AS date, count(*) AS n, CAST(2 * count(*) AS BIGINT) AS n_contributions
FROM part WHERE p_partkey % 14 <> 1 GROUP BY ALL""")(lambda t: validity(t)[1].groupBy("strength", "agent", "date").agg(F.count("*").alias("n"), F.sum(F.size("contributions")).alias("n_contributions")))
query("b7_validity_propositions", """SELECT CASE WHEN p_partkey % 3 <> 0 THEN concat('ncbigene:', p_partkey) END AS gene, concat('http://purl.obolibrary.org/obo/MONDO_', p_partkey) AS disease, 'http://purl.obolibrary.org/obo/HP_0000006' AS moi
FROM part WHERE p_partkey % 14 <> 1""")(lambda t: validity(t)[0].select("gene", "disease", "moi"))
query("b15_gene_rewrite", "SELECT concat('gv:', p_partkey) AS s, 'cg:gene' AS p, CASE WHEN p_partkey % 10 <> 0 THEN concat('https://identifiers.org/ncbigene:', p_partkey) ELSE concat('HGNC:', p_partkey) END AS o FROM part")(
    lambda t: builders.rewrite_genes(t.part.select(text_of(before="gv:").alias("s"), F.lit("cg:gene").alias("p"), text_of(before="HGNC:").alias("o")), builders.hgnc_map(builders.gene_triples(genes(t))))
)
_LABELS = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in vocab.GENCC_SUBMITTERS.items())
query("v2_submitter_labels", f"SELECT CAST(p_partkey AS VARCHAR) AS uuid, l.label FROM part LEFT JOIN (VALUES {_LABELS}) l(curie, label) ON l.curie = {_SUBMITTER} WHERE p_partkey % 14 <> 1")(
    lambda t: gencc(t).select("uuid", vocab.lookup(vocab.GENCC_SUBMITTERS, "submitter_curie").alias("label"))
)
query("s7_genebayes", """SELECT concat('HGNC:', p_partkey) AS hgnc, CASE WHEN p_partkey % 5 = 0 THEN -1.0 ELSE CAST(p_size AS DOUBLE) / 8 END AS lower95, CAST(p_partkey AS DOUBLE) AS observed FROM part""")(
    lambda t: files.load_genebayes(t.spark, csv_file(t.part.select(
        text_of().alias("ensg"), text_of(before="HGNC:").alias("hgnc"), F.lit("1").alias("chrom"), text_of().alias("observed"), *[F.lit("1").alias(c) for c in ("expected", "prior_mean", "mean")],
        F.when(F.col(K) % 5 == 0, "NA").otherwise((F.col("p_size") / 8).cast("string")).alias("lower95"), F.lit("1").alias("upper95"),
    ), "genebayes")).select("hgnc", "lower95", "observed")
)
query("s8_affiliations", "SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS label FROM supplier UNION SELECT concat('4', s_suppkey), concat('V', s_suppkey) FROM supplier WHERE s_suppkey % 2 = 0")(
    lambda t: files.load_affiliations(t.spark, csv_file(t.supplier.select(
        F.col("s_name").alias("label"), F.concat(F.lit(" "), F.col("s_suppkey").cast("string"), F.lit(" ")).alias("id"), F.when(F.col("s_suppkey") % 2 == 0, text_of("s_suppkey", "V")).alias("vcep_label"),
        F.when(F.col("s_suppkey") % 2 == 0, text_of("s_suppkey", "4")).alias("vcep_id"), F.lit(None).cast("string").alias("gcep_label"), F.lit(" ").alias("gcep_id"),
    ), "affiliations"))
)
query("s9_affiliations_json", "SELECT concat('https://curation.example.org/agent/', s_suppkey) AS iri, s_name AS label FROM supplier")(
    lambda t: files.load_affiliations_json(t.spark, documents_of(t.supplier, F.to_json(F.collect_list(F.struct(text_of("s_suppkey").alias("affiliation_id"), F.col("s_name").alias("affiliation_fullname")))), "affiliations", F.col("s_suppkey")))
)
query("s10_submitters", "SELECT concat('https://identifiers.org/clinvar.submitter:', c_custkey) AS iri, c_name AS label FROM customer")(
    lambda t: files.load_submitters(t.spark, csv_file(t.customer.select(F.col("c_name").alias("name"), text_of("c_custkey").alias("id"), F.lit("lab").alias("type")), "submitters", "\t"))
)


def express(t: Source) -> DataFrame:
    k = F.col(K)
    report = F.struct(
        F.col("p_name").alias("title"), F.lit("2019-01-02").alias("dateISO8601"), F.struct(F.lit("10007").alias("id")).alias("affiliation"), F.when(k % 2 == 0, "{}").otherwise("").alias("scoreJsonSerialized"),
        F.create_map(F.lit("a"), F.struct(pick(["Strong*", "Limited", "unheard of"], k % 3).alias("label"))).alias("scores"), F.create_map(F.lit("g"), F.struct(text_of(before="HGNC:").alias("curie"))).alias("genes"),
        F.create_map(F.lit("c"), F.struct(text_of(before="mondo:").alias("iri"))).alias("conditions"), F.lit("AD (HP:0000006)").alias("modeOfInheritance"),
    )
    entries = F.map_from_entries(F.collect_list(F.struct(text_of(before="r"), report)))
    return files.load_gci_express(t.spark, documents_of(t.part, F.to_json(entries), "express", k))


query("s11_gci_express", "SELECT concat('r', p_partkey) AS id, p_name AS title, 'AD (HP:0000006)' AS \"modeOfInheritance\" FROM part")(lambda t: express(t).select("id", "title", "modeOfInheritance"))
query("b13_express_reports", """SELECT concat('cggciex:report_r', p_partkey) AS report, CASE p_partkey % 3 WHEN 0 THEN 'sepio:StrongEvidence' WHEN 1 THEN 'sepio:LimitedEvidence' END AS level,
CASE WHEN p_partkey % 2 = 0 THEN 'sepio:GeneValidityEvaluationCriteriaSOP4' ELSE 'sepio:GeneValidityEvaluationCriteriaSOP5' END AS specified_by, concat('HGNC:', p_partkey) AS gene, 'http://purl.obolibrary.org/obo/HP_0000006' AS moi FROM part""")(
    lambda t: builders.express_reports(express(t)).select("report", "level", "specified_by", "gene", "moi")
)
query("s15_score_rows", "SELECT concat('gene:', p_partkey) AS about, CAST(p_size AS DOUBLE) / 4 AS score FROM part WHERE p_partkey % 3 <> 2")(
    lambda t: files.load_score_rows(
        t.spark, text_file(t.part.select(tabbed(F.lit("chr1"), F.lit("1"), F.lit("2"), F.concat(pick(["G", "A", "unknown"], F.col(K) % 3), K, F.lit("|more")), (F.col("p_size") / 4).cast("string"))), "scores"),
        t.part.select(text_of(before="gene:").alias("iri"), text_of(before="G").alias("symbol"), F.array(text_of(before="A")).alias("aliases")),
    )
)
query("s16_contributed_cnv", "SELECT CAST(o_orderkey AS VARCHAR) AS case_id, concat('a, \"', o_orderpriority, '\"') AS phenotype, CAST(o_custkey AS VARCHAR) AS start FROM orders")(
    lambda t: files.load_contributed_cnv(t.spark, csv_file(t.orders.select(*[
        (text_of("o_orderkey") if c == "case_id" else F.concat(F.lit('a, "'), "o_orderpriority", F.lit('"')) if c == "phenotype" else text_of("o_custkey") if c == "start" else F.lit("x")).alias(c) for c in files.CONTRIBUTED
    ]), "contributed")).select("case_id", "phenotype", "start")
)
query("s17_table", "SELECT CAST(c_custkey AS VARCHAR) AS tax_id, c_name AS symbol FROM customer")(lambda t: files.load_table(t.spark, csv_file(t.customer.select(text_of("c_custkey").alias("tax_id"), F.col("c_name").alias("symbol")), "table", "\t")))


def json_lines(t: Source) -> str:
    path = sinks.shared_folder(t.spark, "lines")
    sinks.write_json(t.orders.select("o_orderkey", "o_orderstatus"), path)
    return path


query("s18_ndjson", "SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, o_orderstatus FROM orders")(lambda t: files.load_ndjson(t.spark, json_lines(t), "o_orderkey long, o_orderstatus string"))
query("k4_json_array", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")(
    lambda t: sinks.json_array(t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"))).select(F.explode(F.from_json("json", "array<struct<o_orderstatus:string,n:long>>")).alias("x")).select("x.*")
)


def event_log(t: Source) -> str:
    path = sinks.shared_folder(t.spark, "log")
    t.events.select(F.col("user_id").cast("string").alias("key"), F.col("props").cast("string").alias("value"), F.col("event_type").alias("topic"), F.col("ts").cast("timestamp").alias("ts")).write.parquet(path)
    return path


query("s19_event_log", "SELECT CAST(user_id AS VARCHAR) AS key, event_type AS topic, count(*) AS n FROM events GROUP BY ALL")(lambda t: files.read_event_log(t.spark, event_log(t)).groupBy("key", "topic").agg(F.count("*").alias("n")))
query("s14_ntriples", "SELECT concat('http://c/', c_custkey) AS s, 'http://n' AS p, c_name AS o, 'literal' AS o_kind FROM customer UNION ALL SELECT concat('http://c/', c_custkey), 'http://m', concat('_:b', c_nationkey), 'bnode' FROM customer UNION ALL SELECT concat('http://c/', c_custkey), 'http://k', concat('http://k/', c_nationkey), 'iri' FROM customer")(
    lambda t: files.load_ntriples(t.spark, text_file(t.customer.select(F.explode(F.array(
        F.concat(F.lit("<http://c/"), "c_custkey", F.lit('> <http://n> "'), "c_name", F.lit('"@en .')), F.concat(F.lit("<http://c/"), "c_custkey", F.lit("> <http://m> _:b"), "c_nationkey", F.lit(" .")),
        F.concat(F.lit("<http://c/"), "c_custkey", F.lit("> <http://k> <http://k/"), "c_nationkey", F.lit("> .")), F.lit("no triple"),
    ))), "triples"), "g").select("s", "p", "o", "o_kind")
)
query("f13_not_blank", "SELECT concat('http://c/', c_custkey) AS s, c_name AS o FROM customer")(
    lambda t: files.load_ntriples(t.spark, text_file(t.customer.select(F.explode(F.array(
        F.concat(F.lit("<http://c/"), "c_custkey", F.lit('> <http://n> "'), "c_name", F.lit('" .')), F.concat(F.lit("<http://c/"), "c_custkey", F.lit("> <http://m> _:b"), "c_nationkey", F.lit(" .")),
    ))), "triples"), "g").where(~(F.col("o_kind") == "bnode")).select("s", "o")
)

# ---- dosage records ----------------------------------------------------------------------------------------------


def dosage(t: Source) -> DataFrame:
    k = F.col(K)
    fields = F.create_map(
        F.lit("customfield_10165"), pick(["3", "0", "30: Gene associated with autosomal recessive phenotype"], k % 3), F.lit("customfield_10166"), pick(["40: Dosage sensitivity unlikely", "x"], k % 2),
        F.lit("customfield_10183"), F.concat(F.lit("PMID: "), K), F.lit("customfield_10160"), F.concat(F.lit("chr1:"), K, F.lit(",000-"), K, F.lit(",900")), F.lit("customfield_10198"), F.col("p_name"),
    )
    return t.part.select(
        text_of(before="ISCA-").alias("key"), fields.alias("fields"), F.lit("Closed").alias("status"), F.when(k % 4 == 0, "Open").otherwise("Complete").alias("resolution"), F.lit("2018-03-27T09:55:41.000-0400").alias("resolutiondate"),
        F.lit("u").alias("updated"), F.when(k % 5 == 0, F.array(F.lit("Recurrent"))).alias("labels"), F.when(k % 2 == 0, F.concat(F.lit("https://www.ncbi.nlm.nih.gov/gene/"), K)).alias("gene"),
    )


_FEATURE = "CASE WHEN p_partkey % 2 = 0 THEN concat('https://identifiers.org/ncbigene:', p_partkey) ELSE concat('https://curation.example.org/r/dci/ISCA-', p_partkey) END"
query("b9_dosage_statements", f"""SELECT concat('https://curation.example.org/r/dci/ISCA-', p_partkey, 'x1-u') AS assertion, {_FEATURE} AS feature, 'cg:Haploinsufficiency' AS mechanism,
CASE p_partkey % 3 WHEN 0 THEN 'cg:DosageSufficientEvidence' WHEN 1 THEN 'cg:DosageNoEvidence' ELSE 'cg:DosageAutosomalRecessive' END AS strength, p_name AS description, concat('https://identifiers.org/pubmed:', p_partkey) AS source FROM part
UNION ALL SELECT concat('https://curation.example.org/r/dci/ISCA-', p_partkey, 'x3-u'), {_FEATURE}, 'cg:Triplosensitivity', CASE WHEN p_partkey % 2 = 0 THEN 'cg:DosageSensitivityUnlikely' ELSE 'cg:NoAssertion' END, '', NULL FROM part""")(
    lambda t: builders.dosage_statements(dosage(t)).select("assertion", "feature", "mechanism", "strength", "description", F.try_element_at("evidence", F.lit(1))["source"].alias("source"))
)
query("b9_dosage_regions", """SELECT concat('https://curation.example.org/r/dci/ISCA-', p_partkey) AS region, p_partkey % 5 = 0 AS recurrent, CAST(p_partkey * 1000 AS BIGINT) AS start, CAST(p_partkey * 1000 + 900 AS BIGINT) AS "end" FROM part WHERE p_partkey % 2 <> 0""")(
    lambda t: builders.dosage_regions(dosage(t), {"grch37": "customfield_10160", "grch38": "customfield_10532"}).select("region", "recurrent", "defining.start", "defining.end")
)
query("f17_valid_dosage", "SELECT concat('ISCA-', p_partkey) AS key FROM part WHERE p_partkey % 4 <> 0")(lambda t: dosage(t).where(filters.dosage_record_ok()).select("key"))
query("b10_dosage_reports", f"""SELECT concat('https://curation.example.org/r/dci/ISCA-', p_partkey, '-u') AS report, {_FEATURE} AS feature, CAST(2 AS BIGINT) AS n_statements,
CASE p_partkey % 3 WHEN 0 THEN 'cg:DosageSufficientEvidence' WHEN 1 THEN 'cg:DosageNoEvidence' ELSE 'cg:DosageAutosomalRecessive' END AS haplo, CASE WHEN p_partkey % 2 = 0 THEN 'cg:DosageSensitivityUnlikely' ELSE 'cg:NoAssertion' END AS triplo FROM part""")(
    lambda t: builders.dosage_reports(builders.dosage_statements(dosage(t))).select("report", "feature", F.size("statements").cast("long").alias("n_statements"), F.col("statements")[0]["strength"].alias("haplo"), F.col("statements")[1]["strength"].alias("triplo"))
)

# ---- writers and keyed tables ------------------------------------------------------------------------------------


def keyed(t: Source, schema: str = "key string, value string") -> sinks.KeyedTable:
    return sinks.KeyedTable(t.spark, sinks.shared_folder(t.spark, "keyed"), schema)


def _upserted(t: Source) -> sinks.KeyedTable:
    table = keyed(t)
    rows = t.orders.select(text_of("o_orderkey").alias("key"), F.col("o_orderstatus").alias("value"))
    table.merge(upserts=rows)
    table.merge(upserts=rows.where("value = 'P'").withColumn("value", F.lit("changed")))
    return table


query("k1_upserts", "SELECT CAST(o_orderkey AS VARCHAR) AS key, CASE o_orderstatus WHEN 'P' THEN 'changed' ELSE o_orderstatus END AS value FROM orders")(lambda t: _upserted(t).read())


def _deleted(t: Source) -> DataFrame:
    table = _upserted(t)
    table.merge(deletes=table.read().where("value = 'F'").select("key"))
    table.vacuum()
    return table.read()


query("k2_deletes", "SELECT CAST(o_orderkey AS VARCHAR) AS key, CASE o_orderstatus WHEN 'P' THEN 'changed' ELSE o_orderstatus END AS value FROM orders WHERE o_orderstatus <> 'F'")(_deleted)


def _report(t: Source) -> DataFrame:
    path = sinks.shared_folder(t.spark, "report")
    sinks.write_report(t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n")), path, sep="\t")
    return t.spark.read.csv(path, header=True, sep="\t", schema="o_orderpriority string, n long")


query("k3_report", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority")(_report)


def minimised(t: Source) -> DataFrame:
    k = F.col("o_orderkey").cast("string")
    own = [("cg:contributions", F.concat(F.lit("c"), k)), ("cg:evidence", F.lit("e")), ("cg:label", F.col("o_orderpriority"))]
    rows = [F.struct(F.concat(F.lit("a"), k).alias("s"), F.lit(p).alias("p"), o.alias("o")) for p, o in own]
    rows += [F.struct(F.concat(F.lit("c"), k).alias("s"), F.lit(p).alias("p"), o.alias("o")) for p, o in (("cg:role", F.lit("cg:Publisher")), ("cg:date", F.date_format("o_orderdate", "yyyy-MM-dd")))]
    rows += [F.struct(F.concat(F.lit("p"), k).alias("s"), F.lit("rdf:type").alias("p"), F.lit("cg:GeneDiseaseValidityProposition").alias("o"))]
    graphs = t.orders.select(k.alias("g"), F.explode(F.array(*rows)).alias("t")).select("g", "t.*")
    return builders.minimised_versions(graphs, t.orders.select(k.alias("g"), F.concat(F.lit("a"), k).alias("assertion"), F.concat(F.lit("b"), k).alias("successor")))


query("b14_minimised_versions", """SELECT CAST(o_orderkey AS VARCHAR) AS g, concat('a', o_orderkey) AS s, 'cg:label' AS p, o_orderpriority AS o FROM orders UNION ALL SELECT CAST(o_orderkey AS VARCHAR), concat('a', o_orderkey), 'prov:wasInvalidatedBy', concat('b', o_orderkey) FROM orders
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), concat('a', o_orderkey), 'dc:dateSubmitted', strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') FROM orders UNION ALL SELECT CAST(o_orderkey AS VARCHAR), concat('p', o_orderkey), 'rdf:type', 'cg:GeneDiseaseValidityProposition' FROM orders""")(minimised)
