"""Corpus pipeline over `documents`: toxicity, language ID, near-duplicates, benchmark decontamination, token ids.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a DataFrame; run()
writes it as Parquet in the shared folder and reads it again for the next stage. All stages but the last return the
columns of `documents`.

Defined results: rows are judged one by one, whatever their ids: null and repeated ids are rows like others. A null or
empty text scores as the toxicity model's intercept does and goes as a text without a letter in the language stage. Of
rows with equal texts that one stays which near_duplicates() names. Very long texts are judged whole. A table without
rows, labels or benchmark items is no error: nothing is rejected for want of them. Further columns pass through all
stages but the last: the stages' own columns take names that no column has.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import op02_toxicity, op04_language, op07_ngram_join, op09_decontaminate
from helixframe.llm import op10_bpe as bpe
from helixframe.llm.common import learn_bucket, small_batches, stored, table
from helixframe.llm.queries import VOCABULARY


def free(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it one that no column has in any case."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic (0.5 or more) go. The model learns from the labels of the folder."""
    small_batches(spark)
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(learn_bucket("doc_id", 5) != 0)
    model = op02_toxicity.fit(docs, labels)
    score, flag = free(docs, "_toxic_score", "_toxic")
    return op02_toxicity.score(docs, model, out=score, flag=flag).where(F.col(flag) == 0).select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told (no letters, or too narrow a margin) go."""
    small_batches(spark)
    dictionaries = op04_language.fit(docs.where(learn_bucket("doc_id", 3) != 1))
    lang, sure, rejected = free(docs, "_lang_pred", "_lang_score", "_lang_rejected")
    judged = op04_language.predict(docs, dictionaries, out=lang, score=sure, rejected=rejected)
    return judged.where(~F.col(rejected)).select(*docs.columns)


#: Files whose names may be broadcast to number their rows (names are cut off by no system below 4 KB: 80 MB at the very most).
MAX_FILES = 20_000


def file_scan(docs: DataFrame) -> bool:
    """Whether docs is a plain scan of files: then a row is known by its file and its place in it, however often it is read."""
    if not docs._jdf.queryExecution().analyzed().children().isEmpty():
        return False
    try:
        docs.select(docs.metadataColumn("_metadata")["row_index"])
    except AnalysisException:
        return False
    return True


def numbered(docs: DataFrame, what: str) -> tuple[DataFrame, str]:
    """The rows with a number each, so that rows with null or equal ids are told apart; and the number's column.

    Rows of a file scan, as every stage gets them, are numbered by file and place and aren't copied. Others, and those of
    more than MAX_FILES files, are written with their numbers, as numbers given while reading may differ the next time.
    """
    row, name, number = free(docs, "_row_number", "_file_name", "_file_number")
    if file_scan(docs):
        meta = docs.metadataColumn("_metadata")
        names = [r[0] for r in docs.select(meta["file_path"]).distinct().limit(MAX_FILES + 1).collect()]
        if len(names) <= MAX_FILES:
            files = docs.sparkSession.createDataFrame(list(enumerate(sorted(names))), f"{number} long, {name} string")
            placed = docs.select("*", meta["file_path"].alias(name), meta["row_index"].alias(row)).join(F.broadcast(files), name)
            return placed.withColumn(row, F.shiftleft(number, 40) + F.col(row)).select(*docs.columns, row), row
    return stored(docs.withColumn(row, F.monotonically_increasing_id()), what), row


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Meanwhile, shuffle files go as soon as a query ends: what it gave is written, so nothing reads them again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays, that with the smallest id (a null id last), of equal ids the first row."""
    small_batches(spark)
    rows, row = numbered(docs, "duplicates-rows")
    with shuffles_freed(spark):
        classes = op07_ngram_join.near_duplicates(rows, key=row).where("n_links > 0").select(row, "class_id")
        classes = stored(classes.join(rows.select(row, "doc_id"), row), "duplicate-classes")
    first = classes.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row))[row].alias("first"))
    goes = classes.join(first, "class_id").where(F.col(row) != F.col("first")).select(row)
    return rows.join(stored(goes, "duplicates"), row, "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go."""
    rows, row = numbered(docs, "contaminated-rows")
    held = op09_decontaminate.contaminated(rows, table(spark, sf_dir, "benchmark"), op09_decontaminate.Params(verbatim=True), key=row).select(row).distinct()
    return rows.join(stored(held, "contaminated"), row, "left_anti").select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents that are left."""
    small_batches(spark)
    return bpe.encode(docs, VOCABULARY).select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [
    ("toxicity", toxicity),
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("BPE encoding", encoding),
]

#: Trained models and tokenisation can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage-{i}")
    return docs
