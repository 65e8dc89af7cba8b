"""Readers of source files (S1-S23). Each takes (spark, path) and returns typed columns; SOURCES lists them.

Compressed files that Spark can't split are dealt out again right after the read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..functions import vocab
from .records import split_records

_INTS = ["outerStart", "innerStart", "start", "stop", "innerStop", "outerStop", "display_start", "display_stop", "variantLength", "positionVCF", "forDisplayLength"]
_TEXTS = ["Assembly", "Chr", "Accession", "Strand", "referenceAllele", "alternateAllele"]


def _attributes(names: list[str], kind: str = "string") -> str:
    return ", ".join(f"`_{n}` {kind}" for n in names)


_LOCATIONS = f"struct<SequenceLocation: array<struct<{', '.join(f'_{n}: bigint' for n in _INTS)}, {', '.join(f'_{n}: string' for n in _TEXTS)}>>>"
ARCHIVE = f"""
`_Accession` string, `_Version` string, ClassifiedRecord struct<
  SimpleAllele: struct<_AlleleID: string, _VariationID: string, VariantType: string, CanonicalSPDI: string, Name: string,
    GeneList: struct<Gene: array<struct<_GeneID: string>>>, Location: {_LOCATIONS},
    HGVSlist: struct<HGVS: array<struct<NucleotideExpression: struct<Expression: string>>>>>,
  ClinicalAssertionList: struct<ClinicalAssertion: array<struct<
    ClinVarAccession: struct<_Accession: string, _Version: string, _DateUpdated: string, _DateCreated: string, _SubmitterName: string, _OrgID: string>,
    Classification: struct<_DateLastEvaluated: string, ReviewStatus: string, Comment: string, GermlineClassification: string>,
    SimpleAllele: struct<AttributeSet: array<struct<Attribute: struct<_Type: string, _VALUE: string>>>>,
    ObservedInList: struct<ObservedIn: array<struct<Sample: struct<Origin: string>>>>>>>>"""


def load_archive(spark: SparkSession, path: str, row_tag: str = "VariationArchive", partitions: int | None = None) -> DataFrame:
    """Variant archive XML: one row per record (S1, D15). Records without a simple allele have null variation ids.

    The file is cut at the end tags by a scan that Spark splits (compressed files by partitions, if given, after the cut),
    and every record is parsed by itself.
    """
    records = split_records(spark, path, row_tag, simple=True)
    records = records.repartition(partitions) if partitions else records
    raw = records.select(F.from_xml("record", ARCHIVE, {"mode": "PERMISSIVE"}).alias("r")).select("r.*")
    sa, list_ = "ClassifiedRecord.SimpleAllele", "ClassifiedRecord.ClinicalAssertionList.ClinicalAssertion"
    location = F.transform(F.coalesce(F.col(f"{sa}.Location.SequenceLocation"), F.array().cast(T.ArrayType(_location_type()))), lambda x: F.struct(*[x[f"_{n}"].alias(n) for n in [*_INTS, *_TEXTS]]))
    copies = F.try_element_at(F.filter(F.flatten(F.transform(F.col(list_), lambda a: F.coalesce(F.transform(a["SimpleAllele"]["AttributeSet"], lambda s: s["Attribute"]), F.array().cast("array<struct<_Type:string,_VALUE:string>>")))), lambda x: x["_Type"] == "AbsoluteCopyNumber"), F.lit(1))
    classified = F.transform(F.col(list_), lambda a: F.struct(
        a["ClinVarAccession"]["_Accession"].alias("accession"), a["ClinVarAccession"]["_Version"].alias("version"), a["ClinVarAccession"]["_DateUpdated"].alias("DateUpdated"),
        a["ClinVarAccession"]["_DateCreated"].alias("DateCreated"), a["ClinVarAccession"]["_SubmitterName"].alias("submitter_name"), a["ClinVarAccession"]["_OrgID"].alias("org_id"),
        a["Classification"]["_DateLastEvaluated"].alias("DateLastEvaluated"), a["Classification"]["ReviewStatus"].alias("review_status"), a["Classification"]["Comment"].alias("comment"),
        a["Classification"]["GermlineClassification"].alias("classification"), F.try_element_at(a["ObservedInList"]["ObservedIn"]["Sample"]["Origin"], F.lit(1)).alias("origin"),
    ))
    return raw.select(
        F.col("_Accession").alias("vcv_id"), F.col("_Version").alias("vcv_version"), F.col(f"{sa}._AlleleID").alias("allele_id"), F.col(f"{sa}._VariationID").alias("variation_id"),
        F.col(f"{sa}.VariantType").alias("variant_type"), F.col(f"{sa}.CanonicalSPDI").alias("spdi"), F.col(f"{sa}.Name").alias("name"), F.col(f"{sa}.GeneList.Gene._GeneID").alias("genes"),
        location.alias("locations"), F.array_compact(F.col(f"{sa}.HGVSlist.HGVS.NucleotideExpression.Expression")).alias("hgvs"), S.long_or_null(copies["_VALUE"]).alias("copy_count"), classified.alias("classifications"),
    )


def _location_type() -> T.StructType:
    return T.StructType([T.StructField(f"_{n}", T.LongType()) for n in _INTS] + [T.StructField(f"_{n}", T.StringType()) for n in _TEXTS])


def _tabbed(spark: SparkSession, path: str, columns: list[str], comment: str | None = "#", header: bool = False, sep: str = "\t") -> DataFrame:
    reader = spark.read.option("sep", sep).option("header", header).option("quote", "\u0000" if sep == "\t" else '"').option("escape", '"')
    reader = reader.option("comment", comment) if comment else reader
    return reader.schema(", ".join(f"`{c}` string" for c in columns)).csv(path)


def load_gff(spark: SparkSession, path: str, types: tuple[str, ...] | None = tuple(vocab.GFF_TYPES)) -> DataFrame:
    """Genes, exons and coding sequences (types; None: rows of all types) with their attributes (S3). Rows of three fields or fewer are dropped."""
    raw = _tabbed(spark, path, ["seqid", "source", "type", "start", "end", "score", "strand", "phase", "attributes"]).where("start is not null")
    a = (raw if types is None else raw.where(F.col("type").isin(*types))).withColumn("attrs", S.attributes(F.coalesce("attributes", F.lit(""))))
    start, end = S.long_or_null("start"), S.long_or_null("end")
    return a.select(
        "seqid", "source", "type", vocab.lookup(vocab.GFF_TYPES, "type").alias("so_type"), start.alias("start"), end.alias("end"), "score", "strand", "phase", "attrs",
        F.col("attrs")["ID"].alias("id"), F.col("attrs")["Parent"].alias("parent"), S.gene_id(F.col("attrs")["Dbxref"]).alias("gene_id"), S.feature_hash("type", "seqid", start, end, "strand").alias("hash"),
    )


def gene_features(gff: DataFrame) -> DataFrame:
    """One feature per gene with the set of its locations, over all builds at once."""
    genes = gff.where("type = 'gene' and gene_id is not null")
    location = F.struct(F.concat(F.lit("https://identifiers.org/refseq:"), "seqid").alias("seq_ref"), "start", "end")
    return genes.groupBy(F.concat(F.lit(vocab.PREFIXES["ncbigene"]), "gene_id").alias("iri")).agg(F.min(F.col("attrs")["Name"]).alias("symbol"), F.sort_array(F.collect_set(location)).alias("locations"))


def load_vcf(spark: SparkSession, path: str, keys: list[str] = tuple(vocab.VCF_INFO)) -> DataFrame:
    """VCF rows with the wanted INFO keys as lower-case columns; a key without a value is 'true' (S4)."""
    raw = _tabbed(spark, path, ["chrom", "pos", "id", "ref", "alt", "qual", "filter", "info"])
    m = raw.withColumn("m", S.attributes(F.coalesce("info", F.lit(""))))
    return m.select("chrom", S.long_or_null("pos").alias("pos"), "id", "ref", "alt", "qual", "filter", *[F.col("m")[k].alias(k.lower()) for k in keys])


def vcf_info_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """##INFO header lines: id, description."""
    lines = spark.read.text(path).where(F.startswith("value", F.lit("##INFO")))
    return lines.select(F.regexp_extract("value", r"ID=([^,>]+)", 1).alias("id"), F.regexp_extract("value", r'Description="([^"]*)"', 1).alias("description"))


GENES = "response struct<docs: array<struct<hgnc_id: string, symbol: string, name: string, entrez_id: string, ensembl_gene_id: string, omim_id: array<string>, locus_type: string, location: string, alias_symbol: array<string>, prev_symbol: array<string>, alias_name: array<string>, prev_name: array<string>>>>"


def load_genes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GENES).json(path, multiLine=True).select(F.explode("response.docs").alias("g")).select("g.*")


GENCC = "uuid gene_curie gene_symbol disease_curie disease_title disease_original_curie disease_original_title classification_curie classification_title moi_curie moi_title submitter_curie submitter_title submitted_as_hgnc_id submitted_as_date submitted_run_date".split()


def load_gencc(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the shared validity file by header name, without those of the submitter who is loaded elsewhere."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return raw.where(F.trim("submitter_curie") != vocab.GENCC_SKIPPED_SUBMITTER)


def load_genebayes(spark: SparkSession, path: str) -> DataFrame:
    """LoF estimates; what can't be parsed is -1."""
    names = ["ensg", "hgnc", "chrom", "observed", "expected", "prior_mean", "mean", "lower95", "upper95"]
    raw = _tabbed(spark, path, names, comment=None, header=True, sep=",")
    return raw.select("hgnc", *[S.double_or(c).alias(c) for c in names[3:]])


def load_affiliations(spark: SparkSession, path: str) -> DataFrame:
    """Three (id, label) pairs per row, blanks dropped."""
    raw = _tabbed(spark, path, ["label", "id", "vcep_label", "vcep_id", "gcep_label", "gcep_id"], comment=None, header=True, sep=",")
    pairs = F.array(*[F.struct(F.col(f"{p}id").alias("id"), F.col(f"{p}label").alias("label")) for p in ("", "vcep_", "gcep_")])
    return raw.select(F.explode(pairs).alias("p")).select(F.trim("p.id").alias("id"), F.trim("p.label").alias("label")).where("id <> '' and label <> ''").distinct()


def load_affiliations_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("affiliation_id string, affiliation_fullname string").json(path, multiLine=True).select(F.concat(F.lit(vocab.PREFIXES["cgagent"]), "affiliation_id").alias("iri"), F.col("affiliation_fullname").alias("label"))


def load_submitters(spark: SparkSession, path: str) -> DataFrame:
    """Submitters as agents."""
    raw = _tabbed(spark, path, ["name", "id", "type"], comment=None, header=True)
    return raw.select(F.concat(F.lit(vocab.PREFIXES["cvagent"]), "id").alias("iri"), F.col("name").alias("label"))


GCI_REPORT = "title string, dateISO8601 string, affiliation struct<id: string>, scoreJsonSerialized string, scores map<string, struct<label: string>>, genes map<string, struct<curie: string>>, conditions map<string, struct<iri: string>>, modeOfInheritance string"


def load_gci_express(spark: SparkSession, path: str) -> DataFrame:
    """Reports of a file that maps report ids to reports."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string, struct<{_struct(GCI_REPORT)}>>")).alias("id", "r")).select("id", "r.*")


def _struct(ddl: str) -> str:
    return T._parse_datatype_string(ddl).simpleString()[len("struct<") : -1]


def load_cytobands(spark: SparkSession, path: str, assembly: str) -> DataFrame:
    """Bands with their sequence; unknown contigs are dropped."""
    raw = _tabbed(spark, path, ["chrom", "start", "end", "band", "stain"])
    return raw.select(F.concat(F.regexp_replace("chrom", "^chr", ""), "band").alias("band"), S.refseq("chrom", F.lit(assembly)).alias("seq_ref"), S.long_or_null("start").alias("start"), S.long_or_null("end").alias("end")).where("seq_ref is not null")


def load_ncbi_features(spark: SparkSession, path: str) -> DataFrame:
    """Gene rows by position; leading digits of the coordinates."""
    raw = _tabbed(spark, path, [f"c{i}" for i in range(16)]).where("c0 = 'gene'")
    lead = lambda c: S.long_or_null(F.nullif(F.regexp_extract(c, r"^[0-9]*", 0), F.lit("")))
    return raw.select(F.col("c6").alias("seqid"), lead("c7").alias("start"), lead("c8").alias("end"), F.col("c9").alias("strand"), F.col("c14").alias("symbol"), F.col("c15").alias("gene_id"))


def load_ntriples(spark: SparkSession, path: str, graph: str) -> DataFrame:
    """N-Triples as rows (g, s, p, o, o_kind, o_dt); lines that aren't triples are dropped."""
    line = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[\w-]+|\^\^<[^>]*>)?)\s*\.\s*(?:#.*)?$'
    part = lambda i: F.regexp_extract("value", line, i)
    raw = spark.read.text(path).where(F.col("value").rlike(line)).select(part(1).alias("s"), part(2).alias("p"), part(3).alias("o"))
    bare = lambda c: F.regexp_replace(c, r"^<(.*)>$", "$1")
    kind = F.when(F.startswith("o", F.lit('"')), "literal").when(F.startswith("o", F.lit("_:")), "bnode").otherwise("iri")
    value = F.when(kind == "literal", F.regexp_replace(F.regexp_replace("o", r'^"((?:[^"\\]|\\.)*)".*$', "$1"), r'\\(["\\])', "$1")).otherwise(bare("o"))
    return raw.select(F.lit(graph).alias("g"), bare("s").alias("s"), "p", value.alias("o"), kind.alias("o_kind"), F.nullif(F.regexp_extract("o", r"\^\^<([^>]*)>$", 1), F.lit("")).alias("o_dt"))


def load_score_rows(spark: SparkSession, path: str, genes: DataFrame) -> DataFrame:
    """symbol|…, score rows joined to genes by label, else by alias (S15, B20). genes: (iri, symbol, aliases)."""
    raw = spark.read.text(path).select(F.split("value", "\t").alias("f")).where("size(f) >= 5")
    rows = raw.select(F.split_part(F.col("f")[3], F.lit("|"), F.lit(1)).alias("name"), S.double_or(F.col("f")[4], None).alias("score")).where("score is not null")
    names = genes.select("iri", F.col("symbol").alias("name"), F.lit(0).alias("r")).unionByName(genes.select("iri", F.explode("aliases").alias("name"), F.lit(1).alias("r")))
    one = names.groupBy("name").agg(F.min_by("iri", F.struct("r", "iri")).alias("about"))
    return rows.join(one, "name").select("about", "score")


CONTRIBUTED = ["lab", "case_id", "sex", "phenotype", "iscn", "chrom", "start", "end", "build", "copy_number", "inheritance", "classification", "date", "notes"]


def load_contributed_cnv(spark: SparkSession, path: str) -> DataFrame:
    return _tabbed(spark, path, CONTRIBUTED, comment=None, header=True, sep=",")


def load_table(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated table with a header."""
    return spark.read.csv(path, sep="\t", header=True)


def load_ndjson(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


EVENTS = "key string, value string, topic string, ts timestamp"


def read_event_log(spark: SparkSession, path: str | None = None, kafka: dict | None = None, stream: bool = False) -> DataFrame:
    """Event rows from Parquet files or a topic, as a table or a stream (S19, ST1)."""
    reader = spark.readStream if stream else spark.read
    if kafka is not None:
        raw = reader.format("kafka").options(**kafka).load()
        return raw.select(F.col("key").cast("string"), F.col("value").cast("string"), "topic", F.col("timestamp").alias("ts"))
    return reader.schema(EVENTS).parquet(path)


def objects_with_prefix(objects: DataFrame, prefix: str, key: str = "iri") -> DataFrame:
    """Key-prefix scan: a range on the key, which Parquet statistics can skip by."""
    return objects.where((F.col(key) >= prefix) & (F.col(key) < prefix + "\U0010ffff"))


def object_by_iri(objects: DataFrame, iri: str, key: str = "iri") -> DataFrame:
    return objects.where(F.col(key) == iri)


#: Registry: name -> reader; load order matters, genes and locations before variants.
SOURCES: dict[str, Callable[..., DataFrame]] = {
    "genes": load_genes, "gff": load_gff, "cytobands": load_cytobands, "ncbi_features": load_ncbi_features, "ontology": load_ntriples, "affiliations": load_affiliations,
    "affiliations_json": load_affiliations_json, "submitters": load_submitters, "gencc": load_gencc, "genebayes": load_genebayes, "gci_express": load_gci_express,
    "vcf": load_vcf, "archive": load_archive, "contributed_cnv": load_contributed_cnv, "table": load_table, "ndjson": load_ndjson,
}


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, k) for i, k in enumerate(SOURCES)], "load_order int, source string")
