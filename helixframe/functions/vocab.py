"""Controlled vocabularies, as fixed values that results must carry, and map columns made from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values ------------------------------------------------------------------------------------------------

#: Prefix -> IRI root, of public vocabularies.
PUBLIC_PREFIXES = {
    "dc": "http://purl.org/dc/terms/",
    "hp": "http://purl.obolibrary.org/obo/HP_",
    "sepio": "http://purl.obolibrary.org/obo/SEPIO_",
    "geno": "http://purl.obolibrary.org/obo/GENO_",
    "mondo": "http://purl.obolibrary.org/obo/MONDO_",
    "so": "http://purl.obolibrary.org/obo/SO_",
    "foaf": "http://xmlns.com/foaf/0.1/",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "owl": "http://www.w3.org/2002/07/owl#",
    "skos": "http://www.w3.org/2004/02/skos/core#",
    "ncbigene": "https://identifiers.org/ncbigene:",
    "prov": "http://www.w3.org/ns/prov#",
    "omim": "https://omim.org/entry/",
    "cnt": "http://www.w3.org/2011/content#",
    "hgnc": "https://identifiers.org/hgnc:",
    "pubmed": "https://identifiers.org/pubmed:",
    "ro": "http://purl.obolibrary.org/obo/RO_",
    "ga4gh": "https://terms.ga4gh.org/",
    "cvscv": "https://identifiers.org/clinvar.submission:",
    "cvagent": "https://identifiers.org/clinvar.submitter:",
    "oboinowl": "http://www.geneontology.org/formats/oboInOwl#",
    "efo": "http://www.ebi.ac.uk/efo/EFO_",
    "orphanet": "http://www.orpha.net/ORDO/Orphanet_",
    "schema": "https://schema.org/",
    "ensembl": "http://identifiers.org/ensembl:",
}

#: Prefix -> path below the root of a curation body's own namespace.
OWN_PATHS = {"gg": "r/", "cg": "terms/", "cgdosage": "r/dci/", "cggv": "r/gci/", "cggciex": "r/gci-express/", "cgagent": "agent/", "gencc": "r/gencc/"}
OWN_ROOT = "https://curation.example.org/"


def prefixes(own_root: str = OWN_ROOT) -> dict[str, str]:
    """All prefixes; own_root is where the curation body's own identifiers live."""
    return PUBLIC_PREFIXES | {k: own_root + v for k, v in OWN_PATHS.items()}


PREFIXES = prefixes()

#: Variant type -> copy change (the archive's types, then the short ones of VCF).
COPY_CHANGE = {
    "Deletion": "efo:copy-number-loss", "copy number loss": "efo:copy-number-loss",
    "copy number gain": "efo:copy-number-gain", "Duplication": "efo:copy-number-gain",
    "DEL": "efo:copy-number-loss", "DUP": "efo:copy-number-gain",
}
CNV_TYPES = ["Deletion", "copy number loss", "copy number gain", "Duplication"]

#: Classification label -> class.
ACMG_CLASS = {
    "Likely pathogenic": "cg:LikelyPathogenic", "Uncertain significance": "cg:UncertainSignificance", "Likely benign": "cg:LikelyBenign",
    "probable-pathogenic": "cg:LikelyPathogenic", "pathologic": "cg:Pathogenic", "conflicting data from submitters": "cg:ConflictingData",
    "Likely Pathogenic": "cg:LikelyPathogenic", "pathogenic": "cg:Pathogenic", "Pathogenic": "cg:Pathogenic",
    "Benign/Likely benign": "cg:Benign", "Benign": "cg:Benign", "Pathogenic/Likely pathogenic": "cg:Pathogenic",
}
DIRECTION = {"cg:Pathogenic": "cg:Supports", "cg:LikelyPathogenic": "cg:Supports", "cg:UncertainSignificance": "cg:Inconclusive", "cg:LikelyBenign": "cg:Refutes", "cg:Benign": "cg:Refutes"}
REVIEW_STATUS = {
    "no assertion criteria provided": "cg:NoCriteria", "criteria provided, single submitter": "cg:CriteriaProvided",
    "no classification provided": "cg:NoClassification", "reviewed by expert panel": "cg:ExpertPanel", "flagged submission": "cg:Flagged",
}
INHERITANCE = {
    "maternal": "cg:MaternalInheritance", "paternal": "cg:PaternalInheritance", "inherited": "cg:Inherited", "biparental": "cg:Biparental",
    "uniparental": "cg:Uniparental", "de novo": "cg:DeNovoVariant", "somatic": "cg:SomaticVariation",
}
CONTRIBUTION_ROLES = {"DateCreated": "cg:Creator", "DateLastEvaluated": "cg:Evaluator", "DateUpdated": "cg:Submitter"}
BUILDS = {"hg19": "grch37", "hg38": "grch38", "grch38": "grch38", "grch37": "grch37", "19": "grch37", "38": "grch38"}
CHROMOSOMES = [*map(str, range(1, 23)), "X", "Y"]
#: Build -> chromosome -> RefSeq sequence.
REFSEQ = {
    "grch37": {
        "1": "NC_000001.10", "2": "NC_000002.11", "3": "NC_000003.11", "4": "NC_000004.11", "5": "NC_000005.9", "6": "NC_000006.11",
        "7": "NC_000007.13", "8": "NC_000008.10", "9": "NC_000009.11", "10": "NC_000010.10", "11": "NC_000011.9", "12": "NC_000012.11",
        "13": "NC_000013.10", "14": "NC_000014.8", "15": "NC_000015.9", "16": "NC_000016.9", "17": "NC_000017.10", "18": "NC_000018.9",
        "19": "NC_000019.9", "20": "NC_000020.10", "21": "NC_000021.8", "22": "NC_000022.10", "X": "NC_000023.10", "Y": "NC_000024.9",
    },
    "grch38": {
        "1": "NC_000001.11", "2": "NC_000002.12", "3": "NC_000003.12", "4": "NC_000004.12", "5": "NC_000005.10", "6": "NC_000006.12",
        "7": "NC_000007.14", "8": "NC_000008.11", "9": "NC_000009.12", "10": "NC_000010.11", "11": "NC_000011.10", "12": "NC_000012.12",
        "13": "NC_000013.11", "14": "NC_000014.9", "15": "NC_000015.10", "16": "NC_000016.10", "17": "NC_000017.11", "18": "NC_000018.10",
        "19": "NC_000019.10", "20": "NC_000020.11", "21": "NC_000021.9", "22": "NC_000022.11", "X": "NC_000023.11", "Y": "NC_000024.10",
    },
}
GENCC_CLASS = {
    "GENCC:100001": "cg:Definitive", "GENCC:100002": "cg:Strong", "GENCC:100003": "cg:Moderate", "GENCC:100004": "cg:Limited",
    "GENCC:100005": "cg:Disputed", "GENCC:100006": "cg:Refuted", "GENCC:100008": "cg:NoKnownDiseaseRelationship", "GENCC:100009": "cg:Supportive",
}
GENCC_SKIPPED_SUBMITTER = "GENCC:000102"
GENCC_SUBMITTERS = {
    "GENCC:000101": "Ambry Genetics", "GENCC:000102": "ClinGen", "GENCC:000104": "Genomics England PanelApp", "GENCC:000105": "Illumina", "GENCC:000106": "Invitae",
    "GENCC:000107": "Laboratory for Molecular Medicine", "GENCC:000108": "Myriad Women’s Health", "GENCC:000110": "Orphanet", "GENCC:000111": "PanelApp Australia",
    "GENCC:000112": "G2P", "GENCC:000113": "Franklin by Genoox", "GENCC:000114": "King Faisal Specialist Hospital and Research Center",
    "GENCC:000115": "Broad Center for Mendelian Genomics", "GENCC:000116": "Baylor College of Medicine Research Center",
}
#: INFO keys of structural variants that are read.
VCF_INFO = [
    "END", "ENDMAX", "ENDMIN", "Genes", "POSMAX", "POSMIN", "SVLEN", "SVTYPE", "AC", "AF", "ALGORITHMS", "AN", "BOTHSIDES_SUPPORT", "CHR2", "CN_COUNT", "CN_FREQ",
    "CN_NUMBER", "CN_STATUS", "CPX_INTERVALS", "CPX_TYPE", "END2", "FREQ_HET", "FREQ_HOMALT", "FREQ_HOMREF", "OUTLIER_SAMPLE_ENRICHED_LENIENT", "PREDICTED_LOF", "PREDICTED_COPY_GAIN",
]
DOSAGE_LEVEL = {
    "3": "cg:DosageSufficientEvidence", "2": "cg:DosageModerateEvidence", "1": "cg:DosageMinimalEvidence", "0": "cg:DosageNoEvidence",
    "30: Gene associated with autosomal recessive phenotype": "cg:DosageAutosomalRecessive", "40: Dosage sensitivity unlikely": "cg:DosageSensitivityUnlikely",
}
MECHANISM = {1: "cg:Haploinsufficiency", 3: "cg:Triplosensitivity"}
#: Per mechanism, pairs of (publication, description) fields of a dosage record.
DOSAGE_EVIDENCE_FIELDS = {
    1: [(10183, 10184), (10185, 10186), (10187, 10188), (12231, 12237), (12232, 12238), (12233, 12239)],
    3: [(10189, 10190), (10191, 10192), (10193, 10194), (12234, 12240), (12235, 12241), (12236, 12242)],
}
#: The names in use lack the question mark that some lists carry after "virus integration site".
LOCUS_TYPE = {
    "immunoglobulin gene": "so:0002122", "T cell receptor gene": "so:0002099", "RNA, micro": "so:0000276", "gene with protein product": "so:0001217",
    "RNA, transfer": "so:0000253", "pseudogene": "so:0000336", "RNA, long non-coding": "so:0001877", "virus integration site": "so:0000946",
    "RNA, vault": "so:0000404", "endogenous retrovirus": "so:0000100", "RNA, small nucleolar": "so:0000275", "T cell receptor pseudogene": "so:0002099",
    "immunoglobulin pseudogene": "so:0002098", "RNA, small nuclear": "so:0000274", "readthrough": "so:0000883", "RNA, ribosomal": "so:0000252", "RNA, misc": "so:0000356",
}
GCI_EXPRESS_LEVEL = {
    "Definitive": "sepio:DefinitiveEvidence", "Limited": "sepio:LimitedEvidence", "Moderate": "sepio:ModerateEvidence", "No Reported Evidence": "sepio:NoEvidence",
    "Strong*": "sepio:StrongEvidence", "Contradictory (disputed)": "sepio:DisputingEvidence", "Strong": "sepio:StrongEvidence",
    "Contradictory (refuted)": "sepio:Refuted", "Refuted": "sepio:Refuted", "Disputed": "sepio:DisputingEvidence",
}
GFF_TYPES = {"gene": "so:Gene", "exon": "so:Exon", "CDS": "so:CDS"}
DIRECTION_COLOUR = {"cg:Supports": "255,0,0", "cg:Inconclusive": "0,0,255", "cg:Refutes": "0,255,0"}
OTHER_COLOUR = "100,100,100"
OVERLAP_ORDER = ["CompleteOverlap", "PartialOverlap", "OuterOverlap", "NoOverlap"]
GENE_COUNT_CRITERIA = {25: "Genes25", 35: "Genes35", 50: "Genes50"}
ROLE_ORDER = ["cg:Evaluator", "cg:Submitter", "cg:Creator"]
STRENGTH_ORDER = ["Definitive", "Strong", "Moderate", "Limited", "NoKnownDiseaseRelationship", "Disputed", "Refuted"]


# ---- columns -----------------------------------------------------------------------------------------------------


def lookup(table: dict, key: Column | str, default: str | None = None) -> Column:
    """The table's value for the key; default (or null) where it has none."""
    key = F.col(key) if isinstance(key, str) else key
    made = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    found = F.try_element_at(made, key)
    return found if default is None else F.coalesce(found, F.lit(default))


def refseq_table() -> dict[str, str]:
    """'build|chromosome' -> RefSeq IRI."""
    return {f"{build}|{name}": f"https://identifiers.org/refseq:{sequence}" for build, sequences in REFSEQ.items() for name, sequence in sequences.items()}
