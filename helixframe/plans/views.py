"""The library's input shapes as views over the shared test tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "features": """
SELECT concat('gene:', p_partkey) AS feature, concat('G', p_partkey) AS symbol,
       CASE WHEN p_partkey % 7 = 0 THEN 'DosageRegion' ELSE 'Gene' END AS ftype, (p_partkey % 3 <> 0) AS protein_coding,
       concat('NC_', p_partkey % 10) AS seq_ref, CAST((p_partkey * 7919) % 1000000 AS BIGINT) AS start_pos,
       CAST((p_partkey * 7919) % 1000000 + 500 + p_size * 100 AS BIGINT) AS end_pos
FROM {part}""",
    "variants": """
SELECT concat('var:', o_orderkey) AS variant,
       CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH','3-MEDIUM') THEN 'loss' ELSE 'gain' END AS copy_change,
       concat('NC_', o_orderkey % 10) AS seq_ref,
       CAST((o_orderkey * 104729) % 1000000 AS BIGINT) AS start_outer,
       CAST((o_orderkey * 104729) % 1000000 + CASE WHEN o_orderkey % 4 = 0 THEN 300 ELSE 0 END AS BIGINT) AS start_inner,
       CAST((o_orderkey * 104729) % 1000000 + 1000 + (o_orderkey % 97) * 500 AS BIGINT) AS end_inner,
       CAST((o_orderkey * 104729) % 1000000 + 1000 + (o_orderkey % 97) * 500 + CASE WHEN o_orderkey % 4 = 0 THEN 300 ELSE 0 END AS BIGINT) AS end_outer,
       (o_orderkey % 4 = 0) AS is_range
FROM {orders}""",
    "cnvs": "",
    "assertions": """
SELECT concat('scv:', o_orderkey) AS assertion, concat('var:', o_orderkey) AS variant,
       CASE o_orderstatus WHEN 'F' THEN 'Supports' WHEN 'O' THEN 'Inconclusive' ELSE 'Refutes' END AS direction,
       CASE o_orderkey % 6 WHEN 0 THEN 'OtherClassification' WHEN 1 THEN 'Pathogenic' WHEN 2 THEN 'LikelyPathogenic'
            WHEN 3 THEN 'UncertainSignificance' WHEN 4 THEN 'LikelyBenign' ELSE 'Benign' END AS classification,
       CASE WHEN o_orderkey % 11 = 0 THEN 'Flagged' ELSE 'CriteriaProvided' END AS review_status,
       concat('agent:', o_custkey) AS submitter,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)) END AS date_last_evaluated
FROM {orders}""",
    "mechanism": """
SELECT concat('mech:', p_partkey) AS mech, concat('gene:', p_partkey) AS feature,
       CASE WHEN p_partkey % 2 = 0 THEN 'Haploinsufficiency' ELSE 'Triplosensitivity' END AS mechanism,
       CASE p_partkey % 5 WHEN 0 THEN 'DosageSufficientEvidence' WHEN 1 THEN 'DosageAutosomalRecessive'
            WHEN 2 THEN 'DosageNoEvidence' WHEN 3 THEN 'DosageMinimalEvidence' ELSE 'DosageModerateEvidence' END AS strength
FROM {part}""",
    "validity": """
SELECT concat('gv:', p_partkey) AS stmt, concat('gene:', p_partkey) AS gene, p_type AS disease,
       CASE p_partkey % 3 WHEN 0 THEN 'AD' WHEN 1 THEN 'AR' ELSE 'XL' END AS moi,
       CASE p_size % 4 WHEN 0 THEN 'Definitive' WHEN 1 THEN 'Strong' WHEN 2 THEN 'Moderate' ELSE 'Limited' END AS strength
FROM {part} WHERE p_partkey % 4 <> 3""",
    "lof": "SELECT concat('gene:', p_partkey) AS gene, CAST(p_size AS DOUBLE) / 101.0 AS lower95 FROM {part} WHERE p_partkey % 5 <> 0",
    "annotations": """
SELECT concat('ann:', o_orderkey) AS annotation, concat('scv:', o_orderkey) AS subject,
       CASE WHEN o_orderkey % 2 = 0 THEN 'DosageMapConflict' ELSE 'NoAssessment' END AS classification
FROM {orders} WHERE o_orderkey % 17 = 0""",
    "gene_sets": "SELECT DISTINCT concat('scv:', l_orderkey) AS assertion, concat('gene:', l_partkey) AS gene FROM {lineitem}",
    "triples": """
SELECT concat('order:', o_orderkey) AS s, 'rdf:type' AS p, 'Order' AS o FROM {orders}
UNION ALL SELECT concat('order:', o_orderkey), 'subject', concat('customer:', o_custkey) FROM {orders}
UNION ALL SELECT concat('order:', o_orderkey), 'direction', o_orderstatus FROM {orders}
UNION ALL SELECT concat('customer:', c_custkey), 'rdf:type', c_mktsegment FROM {customer}
UNION ALL SELECT concat('customer:', c_custkey), 'memberOf', concat('nation:', c_nationkey) FROM {customer}
UNION ALL SELECT concat('nation:', n_nationkey), 'rdfs:label', n_name FROM {nation}""",
    "edges": """
SELECT concat('customer:', c_custkey) AS child, concat('nation:', c_nationkey) AS parent FROM {customer}
UNION ALL SELECT concat('nation:', n_nationkey), concat('region:', n_regionkey) FROM {nation}
UNION ALL SELECT concat('region:', r_regionkey), 'world' FROM {region}""",
}

#: Variants, every 23rd of them 600 kb wider, so that some hold very many features.
VIEWS["cnvs"] = VIEWS["variants"].replace("(o_orderkey % 97) * 500", "(o_orderkey % 97) * 500 + CASE WHEN o_orderkey % 23 = 0 THEN 600000 ELSE 0 END")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(VIEWS[name].format_map({t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}))


def with_views(*names: str) -> str:
    """Head of a DuckDB query over the named views; more CTEs may follow after a comma."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n].format_map({t: t for t in TABLES})})" for n in names)
