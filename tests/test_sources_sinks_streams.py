"""Readers, writers and streams on small files."""

import gzip
import json

from pyspark.sql import functions as F

from helixframe.operators import builders, reports
from helixframe.sources import files, sinks
from helixframe.streaming import streams

XML = """<Release><VariationArchive Accession="VCV1" Version="2"><ClassifiedRecord><SimpleAllele AlleleID="7" VariationID="9"><VariantType>Deletion</VariantType><Name>n</Name><CanonicalSPDI>spdi:1</CanonicalSPDI>
<GeneList><Gene GeneID="5"/></GeneList><Location><SequenceLocation Assembly="GRCh38" Chr="1" Accession="NC_000001.11" outerStart="10" innerStart="20" stop="99" display_start="10" display_stop="99"/></Location>
<HGVSlist><HGVS><NucleotideExpression><Expression>NC:g.1del</Expression></NucleotideExpression></HGVS></HGVSlist></SimpleAllele>
<ClinicalAssertionList><ClinicalAssertion><ClinVarAccession Accession="SCV3" Version="1" DateUpdated="2020-01-02" DateCreated="2019-01-01" OrgID="44"/><Classification DateLastEvaluated="2018-05-05"><ReviewStatus>criteria provided, single submitter</ReviewStatus><GermlineClassification>Likely pathogenic</GermlineClassification></Classification>
<ObservedInList><ObservedIn><Sample><Origin>maternal</Origin></Sample></ObservedIn></ObservedInList></ClinicalAssertion></ClinicalAssertionList></ClassifiedRecord></VariationArchive></Release>"""


def test_archive_to_tables(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML)
    rec = files.load_archive(spark, str(tmp_path / "a.xml"))
    v = builders.archive_variants(rec).first()
    assert (v.variant, v.copy_change) == ("https://identifiers.org/clinvar:9", "efo:copy-number-loss")
    loc = builders.variant_locations(builders.archive_variants(rec)).first()
    assert (loc.start_outer, loc.start_inner, loc.end_inner, loc.end_outer, loc.is_range) == (10, 20, 99, 99, True)
    assert [tuple(e) for e in v.included[0].expressions] == [("HGVS", "NC:g.1del"), ("SPDI", "spdi:1")]
    a = builders.archive_assertions(rec).first()
    assert (a.classification, a.direction, a.review_status, a.inheritance, len(a.contributions)) == ("cg:LikelyPathogenic", "cg:Supports", "cg:CriteriaProvided", "cg:MaternalInheritance", 3)
    p = builders.archive_propositions(builders.archive_variants(rec)).first()
    assert p.proposition == a.proposition
    assert files.split_records(spark, str(tmp_path / "a.xml"), "VariationArchive").count() == 1


def test_gff_vcf_bands(spark, tmp_path):
    with gzip.open(tmp_path / "g.gff.gz", "wt") as f:
        f.write("##gff\nNC_1\tR\tgene\t10\t90\t.\t+\t.\tID=g1;Dbxref=GeneID:5,X:1;Name=AB\nNC_1\tR\tmRNA\t10\t90\t.\t+\t.\tID=t1;Parent=g1\nNC_1\tR\texon\t10\t20\t.\t+\t.\tID=e1;Parent=g1x\nNC_1\tR\tregion\t1\nNC_2\tR\tgene\t11\t91\t.\t+\t.\tID=g2;Dbxref=GeneID:5;Name=AB\n")
    gff = files.load_gff(spark, str(tmp_path / "g.gff.gz"))
    assert gff.count() == 3
    assert [len(r.locations) for r in files.gene_features(gff).collect()] == [2]
    (tmp_path / "v.vcf").write_text('##INFO=<ID=END,Number=1,Type=Integer,Description="End, of it">\n#CHROM\nchr1\t5\tid\tN\t<DEL>\t9\tPASS\tEND=50;SVTYPE=DEL;SVLEN=2000;PREDICTED_LOF\n')
    r = files.load_vcf(spark, str(tmp_path / "v.vcf")).first()
    assert (r.pos, r.end, r.svlen, r.predicted_lof) == (5, "50", "2000", "true")
    valid, rejects = builders.build_variants(builders.describe_vcf(files.load_vcf(spark, str(tmp_path / "v.vcf"))))
    assert valid.count() == 1 and rejects.count() == 0
    assert files.vcf_info_dictionary(spark, str(tmp_path / "v.vcf")).collect() == [("END", "End, of it")]
    (tmp_path / "b.tsv").write_text("chr1\t0\t100\tp36\tx\nchrUn\t0\t5\tq\tx\n")
    assert [tuple(r) for r in files.load_cytobands(spark, str(tmp_path / "b.tsv"), "hg19").collect()] == [("1p36", "https://identifiers.org/refseq:NC_000001.10", 0, 100)]


def test_json_csv_ntriples(spark, tmp_path):
    (tmp_path / "genes.json").write_text(json.dumps({"response": {"docs": [{"hgnc_id": "HGNC:1", "symbol": "AB", "name": "a b", "entrez_id": "5", "ensembl_gene_id": "E", "locus_type": "pseudogene", "location": "1p", "alias_symbol": ["X"]}, {"symbol": "NO"}]}}))
    g = files.load_genes(spark, str(tmp_path / "genes.json"))
    assert g.count() == 2 and builders.gene_triples(g).where("p = 'owl:sameAs'").count() == 3
    (tmp_path / "o.nt").write_text('<http://a> <http://p> <http://b> .\n<http://a> <http://l> "x \\"y\\""^^<http://t> .\n_:b <http://p> "z"@en .\nbroken\n')
    assert {tuple(r)[1:] for r in files.load_ntriples(spark, str(tmp_path / "o.nt"), "g").collect()} == {("http://a", "http://p", "http://b", "iri", None), ("http://a", "http://l", 'x "y"', "literal", "http://t"), ("_:b", "http://p", "z", "literal", None)}
    (tmp_path / "e.json").write_text(json.dumps({"r1": {"title": "t", "scoreJsonSerialized": "", "scores": {"a": {"label": "Strong*"}}, "genes": {"g": {"curie": "HGNC:1"}}, "modeOfInheritance": "AD (HP:0000006)"}}))
    e = builders.express_reports(files.load_gci_express(spark, str(tmp_path / "e.json"))).first()
    assert (e.level, e.gene) == ("sepio:StrongEvidence", "HGNC:1")
    (tmp_path / "gencc.csv").write_text('uuid,gene_curie,disease_original_curie,classification_curie,moi_curie,submitter_curie,submitted_as_date,submitted_run_date\n1,HGNC:1,MONDO:1,GENCC:100002,HP:0000006,GENCC:000101,2020-01-01 00:00,2021-01-01\n2,HGNC:1,MONDO:1,GENCC:100002,HP:0000006,GENCC:000102,2020-01-01,2021-01-01\n')
    props, made = builders.shared_validity(files.load_gencc(spark, str(tmp_path / "gencc.csv")), spark.createDataFrame([("HGNC:1", "ncbigene:5")], "hgnc string, entrez string"))
    assert props.count() == 1 and made.first().strength == "cg:Strong" and len(made.first().contributions) == 2
    assert files.catalog(spark).count() == len(files.SOURCES)


def test_dosage_record(spark):
    fields = {"customfield_10165": "3", "customfield_10166": "40: Dosage sensitivity unlikely", "customfield_10183": "PMID 77", "customfield_10160": "chr1:1,000-2,000"}
    df = spark.createDataFrame([("ISCA-1", fields, "Closed", "Complete", "2018-03-27T09:55:41.000-0400", "u", ["Recurrent"], None)], "key string, fields map<string,string>, status string, resolution string, resolutiondate string, updated string, labels array<string>, gene string")
    got = {r.mechanism: r for r in builders.dosage_statements(df).collect()}
    assert got["cg:Haploinsufficiency"].strength == "cg:DosageSufficientEvidence" and got["cg:Haploinsufficiency"].evidence[0].source.endswith(":77")
    assert got["cg:Triplosensitivity"].strength == "cg:DosageSensitivityUnlikely"
    region = builders.dosage_regions(df, {"grch37": "customfield_10160", "grch38": "customfield_10532"}).first()
    assert region.recurrent and region.defining.start == 1000 and len(region.locations) == 1


def test_annotations_and_versions(spark):
    a = spark.createDataFrame([("i", "s", None, None, "me", "2020", ["e1", "e2"])], "iri string, subject string, classification string, description string, agent string, date string, evidence array<string>")
    t = builders.annotation_triples(a)
    assert t.count() == 10 and t.where("p = 'cg:classification'").first().o == "cg:NoAssessment"
    g = spark.createDataFrame([("a", "cg:contributions", "c"), ("a", "cg:label", "x"), ("c", "cg:role", "cg:Publisher"), ("c", "cg:date", "2020"), ("p", "rdf:type", "cg:GeneDiseaseValidityProposition")], "s string, p string, o string")
    got = {tuple(r) for r in builders.minimised_version(g, "a", "b").collect()}
    assert got == {("a", "cg:label", "x"), ("a", "prov:wasInvalidatedBy", "b"), ("a", "dc:dateSubmitted", "2020"), ("p", "rdf:type", "cg:GeneDiseaseValidityProposition")}


def test_reports(spark):
    sets = spark.createDataFrame([("r1", "a"), ("r2", "b")], "region string, gene string")
    other = spark.createDataFrame([("r1", "a"), ("r2", "c")], "region string, gene string")
    assert [r.region for r in reports.differing_regions(sets, other).collect()] == ["r2"]
    assert reports.differing_regions(sets, other, compat=True).count() == 0
    rows = spark.createDataFrame([("x:SCV1", "1", "v:5", "VCV1", "2", "s:9", ["g"]), ("bad", "1", "v:5", "VCV1", "2", "s:9", ["g"])], "assertion string, version string, variant string, vcv string, vcv_version string, submitter string, genes array<string>")
    good, rejects = reports.submission_rows(rows, "r", "2020-01-01")
    assert good.first().scv == "SCV1.1" and rejects.count() == 1


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("chr16", "v", 5, 6, 9, 10, "cg:Supports"), ("chr16", "w", None, None, 9, 10, "x")], "chrom string, variant string, start_outer int, start_inner int, end_inner int, end_outer int, direction string")
    sinks.write_bed(df, str(tmp_path / "bed"), "chr16:1-20")
    assert [r.value for r in spark.read.text(str(tmp_path / "bed")).collect()] == ["browser position chr16:1-20", "chr16\t5\t10\tv\t500\t.\t5\t10\t255,0,0"]
    sinks.write_report(df, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2
    assert len(json.loads(sinks.json_array(df).first().json)) == 2


def test_keyed_table_and_streams(spark, tmp_path):
    schema = "key string, value string, ts long, ok boolean"
    rows = [("a", "1", 1, True), ("b", "1", 2, True), ("a", "2", 3, True), ("b", "x", 4, False), ("c", "1", 5, True)]
    for i, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "log" / f"p{i}"))

    def stream():
        return spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))

    table = sinks.KeyedTable(spark, str(tmp_path / "t1"), schema, order=("ts",))
    streams.start(stream(), streams.publish_or_delete(table, F.col("ok")), str(tmp_path / "c1")).awaitTermination()
    assert {(r.key, r.value) for r in table.read().collect()} == {("a", "2"), ("c", "1")}
    n = table.batches()
    assert table.merge(upserts=table.read().limit(0), batch=0) is False and table.batches() == n
    whole = sinks.KeyedTable(spark, str(tmp_path / "t2"), schema, order=("ts",))
    streams.last_write_wins(whole)(spark.createDataFrame(rows, schema), 0)
    split = sinks.KeyedTable(spark, str(tmp_path / "t3"), schema, order=("ts",))
    streams.start(stream(), streams.last_write_wins(split), str(tmp_path / "c3")).awaitTermination()
    assert sorted(whole.read().collect()) == sorted(split.read().collect())


def test_gate_and_supersede(spark, tmp_path):
    schema = "key string, version string, ts long"
    target, waiting = sinks.KeyedTable(spark, str(tmp_path / "a"), schema, order=("ts",)), sinks.KeyedTable(spark, str(tmp_path / "w"), schema)
    gate = {"open": False}
    fn = streams.gated(streams.last_write_wins(target), lambda: gate["open"], waiting)
    fn(spark.createDataFrame([("k", "1", 1)], schema), 0)
    assert target.read().count() == 0
    gate["open"] = True
    fn(spark.createDataFrame([("j", "1", 2)], schema), 1)
    assert target.read().count() == 2 and waiting.read().count() == 0
    history = sinks.KeyedTable(spark, str(tmp_path / "h"), schema + ", invalidated_by string")
    streams.supersede(target, history)(spark.createDataFrame([("k", "2", 3)], schema), 2)
    assert [(r.key, r.version, r.invalidated_by) for r in history.read().collect()] == [("k", "1", "2")]
    assert {(r.key, r.version) for r in target.read().collect()} == {("k", "2"), ("j", "1")}


def test_region_stream_and_people(spark, tmp_path):
    loc = "seq_ref string, start_outer long, start_inner long, end_inner long, end_outer long, is_range boolean"
    f = spark.createDataFrame([("f", "Gene", True, "s", 5, 5, 6, 6, False)], f"feature string, ftype string, protein_coding boolean, {loc}")
    schema = f"key string, status string, resolution string, resolutiondate string, ts long, {loc}"
    regions, rejects = sinks.KeyedTable(spark, str(tmp_path / "r"), schema, order=("ts",)), sinks.KeyedTable(spark, str(tmp_path / "x"), "key string, status string, ts long", order=("ts",))
    found = sinks.KeyedTable(spark, str(tmp_path / "o"), "key string, feature string, kind string")
    batch = spark.createDataFrame([("a", "Closed", "Complete", "d", 1, "s", 1, 1, 9, 9, False), ("b", "Open", "Complete", "d", 1, "s", 1, 1, 9, 9, False)], schema)
    streams.enrich_regions(f, regions, found, rejects)(batch, 0)
    assert found.read().collect() == [("a", "f", "CompleteOverlap")] and rejects.read().first().key == "b" and regions.read().count() == 1
    people = sinks.KeyedTable(spark, str(tmp_path / "p"), "iri string, email string, given_name string, family_name string, ts long", key="iri", order=("ts",))
    ev = spark.createDataFrame([("created", ("1", "e", "a", "b"), 1), ("other", ("2", "e", "a", "b"), 1)], "event_type string, person struct<id:string,email:string,first_name:string,last_name:string>, ts long")
    streams.person_events(people)(ev, 0)
    assert people.read().count() == 1


def test_keyed_table_rewrites_the_buckets_of_its_keys_alone(spark, tmp_path):
    schema = "key string, value long"
    table = sinks.KeyedTable(spark, str(tmp_path / "t"), schema, buckets=8)
    assert table.read().count() == 0
    rows = spark.createDataFrame([(f"k{i}", i) for i in range(100)], schema)
    assert table.merge(upserts=rows, batch=3)
    first = set((tmp_path / "t" / "data").iterdir())
    assert table.merge(upserts=spark.createDataFrame([("k7", -1), (None, 5)], schema), deletes=spark.createDataFrame([("k8",)], "key string"), batch=4)
    assert not table.merge(deletes=rows, batch=4) and not table.merge(deletes=rows, batch=2)
    new = set((tmp_path / "t" / "data").iterdir()) - first
    assert len(new) == 1 and len([x for x in next(iter(new)).iterdir() if x.name.startswith("bucket=")]) <= 3
    want = {f"k{i}": i for i in range(100) if i != 8} | {"k7": -1, None: 5}
    assert {r.key: r.value for r in table.read().collect()} == want
    assert table.merge(deletes=table.read().where("key is not null").select("key"), batch=9)
    assert [tuple(r) for r in table.read().collect()] == [(None, 5)] and table.batches() == 3
    assert table.vacuum(keep=1) >= 1 and table.read().count() == 1


def test_every_version_and_every_waiting_event_is_kept(spark, tmp_path):
    schema = "key string, version string, ts long"
    history = sinks.KeyedTable(spark, str(tmp_path / "h"), schema + ", invalidated_by string")
    current, waiting = sinks.KeyedTable(spark, str(tmp_path / "c"), schema), sinks.KeyedTable(spark, str(tmp_path / "w"), schema)
    gate = {"open": False}
    fn = streams.gated(streams.supersede(current, history), lambda: gate["open"], waiting)
    fn(spark.createDataFrame([("k", "1", 1), ("k", "2", 2)], schema), 0)
    fn(spark.createDataFrame([("k", "3", 3)], schema), 1)
    fn(spark.createDataFrame([("k", "3", 3)], schema), 1)  # sent again
    gate["open"] = True
    fn(spark.createDataFrame([("k", "4", 4), ("j", "1", 5)], schema), 2)
    assert sorted((r.key, r.version, r.invalidated_by) for r in history.read().collect()) == [("k", "1", "2"), ("k", "2", "3"), ("k", "3", "4")]
    assert {(r.key, r.version) for r in current.read().collect()} == {("k", "4"), ("j", "1")} and waiting.read().count() == 0


def test_reports_and_tracks_of_many_rows_are_several_files(spark, tmp_path):
    df = spark.range(300).select(F.lit("chr1").alias("chrom"), F.col("id").cast("string").alias("variant"), *[F.col("id").alias(c) for c in ("start_outer", "start_inner", "end_inner", "end_outer")], F.lit("x").alias("direction")).repartition(3)
    sinks.write_report(df, str(tmp_path / "many"), single_rows=100)
    sinks.write_report(df, str(tmp_path / "one"))
    files_of = lambda name: [x for x in (tmp_path / name).iterdir() if x.name.endswith(".csv")]
    assert len(files_of("many")) > 1 and len(files_of("one")) == 1
    sinks.write_bed(df, str(tmp_path / "bed"), "chr1:1-9")
    lines = [line for x in sorted((tmp_path / "bed").glob("part-*")) for line in x.read_text().splitlines()]
    assert lines[0].startswith("browser") and len(lines) == 301 and lines[1:] == sorted(lines[1:])
