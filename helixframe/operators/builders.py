"""Records to tables and triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..functions import vocab

REFSEQ = "https://identifiers.org/refseq:"
VARIATION = "https://identifiers.org/clinvar:"


# ---- archive records (B1-B5) -------------------------------------------------------------------------------------


def archive_location(x: Column) -> Column:
    """Six-column location of an archive location: an outer/inner pair where either is given, else start or display start (B2)."""
    s_range, e_range = x["innerStart"].isNotNull() | x["outerStart"].isNotNull(), x["innerStop"].isNotNull() | x["outerStop"].isNotNull()
    s, e = F.coalesce(x["start"], x["display_start"]), F.coalesce(x["stop"], x["display_stop"])
    return F.struct(
        F.concat(F.lit(REFSEQ), x["Accession"]).alias("seq_ref"), F.when(s_range, x["outerStart"]).otherwise(s).alias("start_outer"), F.when(s_range, x["innerStart"]).otherwise(s).alias("start_inner"),
        F.when(e_range, x["innerStop"]).otherwise(e).alias("end_inner"), F.when(e_range, x["outerStop"]).otherwise(e).alias("end_outer"), (s_range | e_range).alias("is_range"),
    )


def archive_variants(records: DataFrame) -> DataFrame:
    """Canonical variants: iri, label, copy change, array of included alleles with location and expressions."""
    expressions = F.transform(F.col("hgvs"), lambda h: F.struct(F.lit("HGVS").alias("syntax"), h.alias("value")))
    expressions = F.array_compact(F.concat(F.coalesce(expressions, F.array().cast("array<struct<syntax:string,value:string>>")), F.array(F.when(F.col("spdi").isNotNull(), F.struct(F.lit("SPDI").alias("syntax"), F.col("spdi").alias("value"))))))
    change = vocab.lookup(vocab.COPY_CHANGE, "variant_type")
    return records.where("variation_id is not null").select(
        F.concat(F.lit(VARIATION), "variation_id").alias("variant"), F.col("name").alias("label"), change.alias("copy_change"),
        F.transform("locations", lambda x: F.struct(change.alias("copy_change"), archive_location(x).alias("location"), expressions.alias("expressions"))).alias("included"),
    )


def variant_locations(variants: DataFrame) -> DataFrame:
    """One row per included allele, with the six location columns (input of the interval join)."""
    return variants.select("variant", "copy_change", F.explode("included").alias("i")).select("variant", "copy_change", "i.location.*")


def archive_propositions(variants: DataFrame) -> DataFrame:
    condition = F.lit("mondo:HereditaryDisease")
    return variants.select(S.content_id("VariantPathogenicityProposition", variant="variant", condition=condition).alias("proposition"), F.lit("cg:VariantPathogenicityProposition").alias("type"), "variant", condition.alias("condition"))


def contributions(agent: Column, source: Column) -> Column:
    """Contributions from the dates that are there."""
    made = [F.when(source[field].isNotNull(), F.struct(agent.alias("agent"), F.lit(role).alias("role"), source[field].alias("date"))) for field, role in vocab.CONTRIBUTION_ROLES.items()]
    return F.array_compact(F.array(*made))


def archive_assertions(records: DataFrame) -> DataFrame:
    """One assertion per submission."""
    rows = records.where("variation_id is not null").select(F.concat(F.lit(VARIATION), "variation_id").alias("variant"), F.explode("classifications").alias("c"))
    label = vocab.lookup(vocab.ACMG_CLASS, F.col("c.classification"), "cg:OtherClassification")
    agent = F.concat(F.lit(vocab.PREFIXES["cvagent"]), F.col("c.org_id"))
    return rows.select(
        F.concat(F.lit(vocab.PREFIXES["cvscv"]), "c.accession").alias("assertion"), "variant",
        S.content_id("VariantPathogenicityProposition", variant="variant", condition=F.lit("mondo:HereditaryDisease")).alias("proposition"),
        label.alias("classification"), vocab.lookup(vocab.DIRECTION, label, "cg:Inconclusive").alias("direction"),
        vocab.lookup(vocab.REVIEW_STATUS, F.col("c.review_status"), "cg:OtherStatus").alias("review_status"), vocab.lookup(vocab.INHERITANCE, F.col("c.origin"), "cg:UnknownInheritance").alias("inheritance"),
        agent.alias("submitter"), F.col("c.DateLastEvaluated").alias("date_last_evaluated"), F.col("c.comment").alias("description"), F.col("c.version").alias("version"),
        contributions(agent, F.col("c")).alias("contributions"),
    )


def to_triples(df: DataFrame, graph: str, key: str = "iri", kind: str | None = None, literals: tuple[str, ...] = (), names: dict[str, str] | None = None) -> DataFrame:
    """Rows to triples: one per non-null column, one per element of an array; structs with an own `iri` emit the link and their own triples.

    literals: columns whose values are literals; all others are resources. names: column -> predicate.
    """
    names = names or {}
    schema = {f.name: f.dataType for f in df.schema.fields}
    parts: list[DataFrame] = []
    cells = []

    def cell(column: str, value: Column) -> Column:
        return F.struct(F.lit(names.get(column, column)).alias("p"), value.cast("string").alias("o"), F.lit("literal" if column in literals else "iri").alias("o_kind"))

    def of_struct(c: str):
        return lambda x: cell(c, x["iri"])

    def of_value(c: str):
        return lambda x: cell(c, x)

    if kind is not None:
        cells.append(F.struct(F.lit("rdf:type").alias("p"), F.lit(kind).alias("o"), F.lit("iri").alias("o_kind")))
    arrays = []
    for c, t in schema.items():
        if c == key:
            continue
        if isinstance(t, T.StructType):
            cells.append(cell(c, F.col(f"`{c}`.iri")))
            parts.append(to_triples(df.where(F.col(c).isNotNull()).select(f"`{c}`.*"), graph, "iri", None, literals, names))
        elif isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StructType):
            arrays.append(F.transform(F.col(c), of_struct(c)))
            parts.append(to_triples(df.select(F.explode(c).alias("x")).select("x.*"), graph, "iri", None, literals, names))
        elif isinstance(t, T.ArrayType):
            arrays.append(F.transform(F.col(c), of_value(c)))
        else:
            cells.append(cell(c, F.col(c)))
    empty = F.array().cast("array<struct<p:string,o:string,o_kind:string>>")
    every = F.concat(F.array(*cells) if cells else empty, *[F.coalesce(a, empty) for a in arrays])
    own = df.select(F.lit(graph).alias("g"), F.col(key).alias("s"), F.explode(every).alias("t")).select("g", "s", "t.*").where("o is not null")
    for p in parts:
        own = own.unionByName(p)
    return own.distinct()


# ---- gene validity, genes, scores (B7, B8, B13, B15, B20, B21) ---------------------------------------------------


def hgnc_map(same_as: DataFrame) -> DataFrame:
    """(hgnc, entrez) from sameAs triples of genes."""
    ids = same_as.where(F.col("p") == "owl:sameAs")
    return ids.where(F.contains("o", F.lit("hgnc"))).groupBy(F.concat(F.lit("HGNC:"), F.regexp_extract("o", r"(\d+)$", 1)).alias("hgnc")).agg(F.min("s").alias("entrez"))


def shared_validity(rows: DataFrame, genes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Propositions and assertions with two contributions each from the shared validity file (B7). genes: (hgnc, entrez)."""
    r = rows.withColumn("hgnc", F.trim("gene_curie")).join(genes, "hgnc", "left")
    disease, moi, agent = S.field_to_iri("disease_original_curie"), S.field_to_iri("moi_curie"), S.field_to_iri("submitter_curie")
    date, run = S.date_part("submitted_as_date"), S.date_part("submitted_run_date")
    r = r.withColumn("proposition", S.content_id("GeneValidityProposition", gene="entrez", disease=disease, moi=moi))
    strength = vocab.lookup(vocab.GENCC_CLASS, "classification_curie")
    r = r.withColumn("assertion", S.content_id("EvidenceStrengthAssertion", agent=agent, date=date, subject="proposition", strength=strength))
    props = r.select("proposition", F.col("entrez").alias("gene"), disease.alias("disease"), moi.alias("moi")).distinct()
    made = F.array(F.struct(agent.alias("agent"), F.lit("cg:Evaluator").alias("role"), date.alias("date")), F.struct(agent.alias("agent"), F.lit("cg:Submitter").alias("role"), run.alias("date")))
    return props, r.select("assertion", "proposition", strength.alias("strength"), agent.alias("agent"), date.alias("date"), made.alias("contributions")).distinct()


def gene_triples(genes: DataFrame, graph: str = "genes") -> DataFrame:
    """Labels, aliases, three sameAs links, types and band of genes that have an Entrez id."""
    s = F.concat(F.lit(vocab.PREFIXES["ncbigene"]), "entrez_id")
    one = lambda p, o, kind: F.array(F.struct(F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind")))
    many = lambda p, c: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.struct(F.lit(p).alias("p"), x.alias("o"), F.lit("literal").alias("o_kind")))
    cells = F.concat(
        one("skos:prefLabel", F.col("symbol"), "literal"), one("skos:altLabel", F.col("name"), "literal"), one("owl:sameAs", F.lower("hgnc_id"), "iri"),
        one("owl:sameAs", F.concat(F.lit("ensembl:"), "ensembl_gene_id"), "iri"), one("owl:sameAs", F.concat(F.lit("ncbigene:"), "entrez_id"), "iri"),
        one("rdf:type", F.lit("so:Gene"), "iri"), one("rdf:type", vocab.lookup(vocab.LOCUS_TYPE, "locus_type"), "iri"), one("so:ChromosomeBand", F.col("location"), "literal"),
        many("skos:hiddenLabel", "alias_symbol"), many("skos:hiddenLabel", "prev_symbol"), many("skos:hiddenLabel", "prev_name"),
    )
    return genes.where("entrez_id is not null").select(F.lit(graph).alias("g"), s.alias("s"), F.explode(cells).alias("t")).select("g", "s", "t.*").where("o is not null").distinct()


def express_reports(reports: DataFrame) -> DataFrame:
    """Report rows: level by label of the first score, procedure by which score text is present, gene, disease."""
    sop = F.when(F.length(F.coalesce("scoreJsonSerialized", F.lit(""))) > 0, "sepio:GeneValidityEvaluationCriteriaSOP4").otherwise("sepio:GeneValidityEvaluationCriteriaSOP5")
    first = lambda m, f: F.try_element_at(F.map_values(m), F.lit(1))[f]
    return reports.select(
        F.concat(F.lit("cggciex:report_"), "id").alias("report"), F.concat(F.lit("cggciex:assertion_"), "id").alias("assertion"), F.concat(F.lit("cggciex:proposition_"), "id").alias("proposition"),
        F.col("title").alias("label"), vocab.lookup(vocab.GCI_EXPRESS_LEVEL, first("scores", "label")).alias("level"), sop.alias("specified_by"),
        first("genes", "curie").alias("gene"), first("conditions", "iri").alias("disease"), S.hpo_iri("modeOfInheritance").alias("moi"), F.col("dateISO8601").alias("date"), F.col("affiliation.id").alias("agent"),
    )


def rewrite_genes(triples: DataFrame, genes: DataFrame, predicate: str = "cg:gene") -> DataFrame:
    """Gene objects to their Entrez ids where they have one (B15). genes: (hgnc, entrez)."""
    j = triples.join(genes, triples["o"] == genes["hgnc"], "left")
    return j.withColumn("o", F.when(F.col("p") == predicate, F.coalesce("entrez", "o")).otherwise(F.col("o"))).drop("hgnc", "entrez")


# ---- dosage records (B9, B10) ------------------------------------------------------------------------------------


def dosage_statements(records: DataFrame) -> DataFrame:
    """Two statements per record, one per mechanism: level, condition, description, evidence lines, contribution.

    records: key, fields (map of field name to text), status, resolution, resolutiondate, updated, labels, gene.
    """
    f = lambda n: F.col("fields")[f"customfield_{n}"]

    def side(dosage: int, level: int, text: int, phenotype: int, mondo: int) -> Column:
        condition = F.coalesce(S.without_spaces(f(phenotype)), S.id_tail(f(mondo), r"MONDO:\d*"), F.lit("mondo:HereditaryDisease"))
        lines = [F.when(f(a).isNotNull(), F.struct(F.concat(F.lit(vocab.PREFIXES["pubmed"]), F.regexp_extract(f(a), r"\d+", 0)).alias("source"), F.coalesce(f(b), F.lit("")).alias("description"))) for a, b in vocab.DOSAGE_EVIDENCE_FIELDS[dosage]]
        return F.struct(
            F.lit(dosage).alias("dosage"), F.lit(vocab.MECHANISM[dosage]).alias("mechanism"), vocab.lookup(vocab.DOSAGE_LEVEL, f(level), "cg:NoAssertion").alias("strength"),
            condition.alias("condition"), F.coalesce(f(text), F.lit("")).alias("description"), F.array_compact(F.array(*lines)).alias("evidence"),
        )

    both = F.array(side(1, 10165, 10198, 10200, 11631), side(3, 10166, 10199, 10201, 11633))
    rows = records.withColumn("m", F.explode(both)).withColumn("feature", F.coalesce(S.replace_root("gene", "https://www.ncbi.nlm.nih.gov/gene/", vocab.PREFIXES["ncbigene"]), F.concat(F.lit(vocab.PREFIXES["cgdosage"]), "key")))
    updated = F.col("updated")
    return rows.select(
        F.concat(F.lit(vocab.PREFIXES["cgdosage"]), "key", F.lit("-"), updated).alias("report"), F.concat(F.lit(vocab.PREFIXES["cgdosage"]), "key", F.lit("x"), "m.dosage", F.lit("-"), updated).alias("assertion"),
        F.concat(F.lit(vocab.PREFIXES["cgdosage"]), "key", F.lit("x"), "m.dosage").alias("proposition"), "feature", "m.mechanism", "m.strength", "m.condition", "m.description", "m.evidence",
        S.offset_instant("resolutiondate").alias("date"), F.lit("cg:Approver").alias("role"),
    )


def dosage_reports(statements: DataFrame) -> DataFrame:
    """One report per record with its two statements, haploinsufficiency first (B10). statements: those of dosage_statements()."""
    parts = F.struct("mechanism", "assertion", "proposition", "strength", "condition", "description", "evidence")
    return statements.groupBy("report", "feature", "date", "role").agg(F.sort_array(F.collect_list(parts)).alias("statements"))


def dosage_regions(records: DataFrame, locus_fields: dict[str, str]) -> DataFrame:
    """Regions (records without a gene) with one location per build, the newest first, and whether they recur (B9). locus_fields: build -> field."""
    made = []
    for build, field in sorted(locus_fields.items(), reverse=True):
        parts = S.locus_parts(F.col("fields")[field])
        made.append(F.when(parts.isNotNull(), F.struct(F.lit(build).alias("build"), S.refseq(parts["chrom"], F.lit(build)).alias("seq_ref"), parts["start"].alias("start"), parts["end"].alias("end"))))
    return records.where("gene is null").select(F.concat(F.lit(vocab.PREFIXES["cgdosage"]), "key").alias("region"), F.array_compact(F.array(*made)).alias("locations"), F.coalesce(F.array_contains("labels", "Recurrent"), F.lit(False)).alias("recurrent")).withColumn("defining", F.try_element_at("locations", F.lit(1)))


# ---- annotations, people, versions, documents (B11, B12, B14, B18) -----------------------------------------------


def annotation_triples(annotations: DataFrame) -> DataFrame:
    """Annotation events to triples; no classification counts as NoAssessment, no description as empty."""
    iri, contribution = F.col("iri"), F.concat("iri", F.lit("contrib"))
    t = lambda s, p, o, kind="iri": F.struct(s.alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("o_kind"))
    cells = F.array(
        t(iri, "rdf:type", F.lit("cg:AssertionAnnotation")), t(iri, "cg:contributions", contribution), t(iri, "cg:subject", F.col("subject")),
        t(iri, "dc:description", F.coalesce("description", F.lit("")), "literal"), t(iri, "cg:classification", F.coalesce("classification", F.lit("cg:NoAssessment"))),
        t(contribution, "cg:agent", F.col("agent")), t(contribution, "cg:role", F.lit("cg:Author")), t(contribution, "cg:date", F.col("date"), "literal"),
    )
    evidence = F.transform(F.coalesce("evidence", F.array().cast("array<string>")), lambda x: t(iri, "cg:evidence", x))
    return annotations.select(F.col("iri").alias("g"), F.explode(F.concat(cells, evidence)).alias("t")).select("g", "t.*").where("o is not null")


def persons(events: DataFrame, *more: str) -> DataFrame:
    """Person events to persons (B12): event_type, person struct(id, email, first_name, last_name); more: columns of the events that are kept."""
    return events.select(*more, F.concat(F.lit(vocab.PREFIXES["cgagent"]), "person.id").alias("iri"), F.col("person.email").alias("email"), F.col("person.first_name").alias("given_name"), F.col("person.last_name").alias("family_name"))


def minimised_versions(graphs: DataFrame, replaced: DataFrame) -> DataFrame:
    """(g, s, p, o): prior versions of assertion graphs, minimised.

    graphs: (g, s, p, o); replaced: (g, assertion, successor). Kept are the assertion's own triples without contributions
    and evidence and its proposition's; new are what invalidated it and its submit and approval dates.
    """
    t = graphs.join(replaced, "g")
    own = t.where("s = assertion")
    kept = own.where(~F.col("p").isin("cg:contributions", "cg:evidence")).select("g", "s", "p", "o")
    props = graphs.where("p = 'rdf:type' and o = 'cg:GeneDiseaseValidityProposition'").select("g", "s").join(replaced.select("g"), "g", "left_semi")
    contribs = own.where("p = 'cg:contributions'").select("g", "assertion", F.col("o").alias("c"))
    dates = graphs.where("p = 'cg:date'").select("g", F.col("s").alias("c"), "o")

    def dated(p: str, o: str, as_: str) -> DataFrame:
        who = graphs.where((F.col("p") == p) & (F.col("o") == o)).select("g", F.col("s").alias("c"))
        return contribs.join(who, ["g", "c"], "left_semi").join(dates, ["g", "c"]).select("g", F.col("assertion").alias("s"), F.lit(as_).alias("p"), "o")

    new = replaced.select("g", F.col("assertion").alias("s"), F.lit("prov:wasInvalidatedBy").alias("p"), F.col("successor").alias("o"))
    out = kept.unionByName(graphs.join(props, ["g", "s"], "left_semi").select("g", "s", "p", "o")).unionByName(new)
    return out.unionByName(dated("cg:role", "cg:Publisher", "dc:dateSubmitted")).unionByName(dated("cg:activityType", "cg:Evaluated", "dc:dateAccepted")).distinct()


def minimised_version(triples: DataFrame, assertion: str, successor: str) -> DataFrame:
    """(s, p, o): the minimised prior version of one assertion's graph."""
    one = triples.sparkSession.createDataFrame([(0, assertion, successor)], "g int, assertion string, successor string")
    return minimised_versions(triples.select(F.lit(0).alias("g"), "s", "p", "o"), one).drop("g")


def search_documents(df: DataFrame, source: str, key: str = "iri", symbols: str | None = None, labels: str | None = None, types: str | None = None, descriptions: str | None = None) -> DataFrame:
    """Search documents: iri, source and arrays of symbols, labels, types, descriptions."""
    as_array = lambda c: F.array().cast("array<string>") if c is None else F.array_compact(F.array(F.col(c))) if not dict(df.dtypes)[c].startswith("array") else F.col(c)
    return df.select(F.col(key).alias("iri"), F.lit(source).alias("source"), as_array(symbols).alias("symbols"), as_array(labels).alias("labels"), as_array(types).alias("types"), as_array(descriptions).alias("descriptions"))


# ---- generic variant descriptions and validation (B16, B17, X12) -------------------------------------------------

DESCRIPTION = "build chrom start start_min start_max end end_min end_max svtype".split()


def describe_vcf(rows: DataFrame) -> DataFrame:
    """VCF rows (load_vcf) as variant descriptions on the newer build."""
    return rows.select("id", F.lit("grch38").alias("build"), "chrom", F.col("pos").cast("string").alias("start"), F.lit(None).cast("string").alias("start_min"), F.lit(None).cast("string").alias("start_max"), F.col("end").alias("end"), F.lit(None).cast("string").alias("end_min"), F.lit(None).cast("string").alias("end_max"), "svtype")


def build_variants(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejects) of variant descriptions.

    valid rows gain the six location columns, copy change and content ids; equal min and max collapse to one
    coordinate, and explicit start and end win over min and max. rejects keep their columns and gain `reasons`. No row
    ends the job.
    """
    coords = {c: S.long_or_null(F.col(c).cast("string")) for c in DESCRIPTION[2:8]}
    c = lambda n: F.col(f"_{n}")
    df = rows.withColumns({f"_{n}": v for n, v in coords.items()}).withColumn("seq_ref", S.refseq("chrom", "build")).withColumn("copy_change", vocab.lookup(vocab.COPY_CHANGE, "svtype"))
    s_out, s_in = F.coalesce(c("start"), c("start_min")), F.coalesce(c("start"), c("start_max"))
    e_in, e_out = F.coalesce(c("end"), c("end_min")), F.coalesce(c("end"), c("end_max"))
    df = df.withColumns({"start_outer": s_out, "start_inner": s_in, "end_inner": e_in, "end_outer": e_out, "is_range": ~(s_out.eqNullSafe(s_in) & e_in.eqNullSafe(e_out))})
    given = [F.when(F.col(n).isNotNull() & (c(n).isNull() | (c(n) < 0)), f"bad {n}") for n in DESCRIPTION[2:8]]
    known = F.lower("build").isin(*vocab.BUILDS)
    reasons = F.array_compact(F.array(
        F.when(F.col("build").isNull() | ~known, "unknown build"), F.when(known & F.col("seq_ref").isNull(), "unknown chromosome"), F.when(F.col("copy_change").isNull(), "unknown variant type"), *given,
        F.when(F.col("start_outer").isNull() | F.col("start_inner").isNull(), "no start"), F.when(F.col("end_inner").isNull() | F.col("end_outer").isNull(), "no end"),
        F.when(F.col("start_outer") > F.col("start_inner"), "start range reversed"), F.when(F.col("end_inner") > F.col("end_outer"), "end range reversed"), F.when(F.col("start_inner") > F.col("end_inner"), "coordinates reversed"),
    ))
    df = df.withColumn("reasons", reasons)
    location = S.content_id("SequenceLocation", seq_ref="seq_ref", start_outer="start_outer", start_inner="start_inner", end_inner="end_inner", end_outer="end_outer")
    valid = df.where("size(reasons) = 0").withColumn("location", location).withColumn("variant", S.content_id("CopyNumberChange", location="location", change="copy_change"))
    drop = [f"_{n}" for n in coords]
    return valid.drop(*drop, "reasons"), df.where("size(reasons) > 0").select(*rows.columns, "reasons")
