"""Operator 3: token counts as delta-maintained rollups.

A change batch holds signed rows (+1 for an inserted document, -1 for a deleted one; a revised count is one of each).
Applying a batch folds its rows to additive deltas per (source, language, tokenizer version), writes them under a name
of its own, and then commits by writing one small row that names the batch and the written deltas. Totals are the
sums over committed deltas. A batch that is applied again after its commit changes nothing; an attempt that died before its
commit is never read; if two attempts commit the same batch, the one with the smaller name counts. compact() folds the
batches that were committed when it began into one row per group; a batch that is committed to the old rollup later is
not among those of the new one and can be applied to it.

Sums are aggregated per task before the shuffle, so a hot source costs one row per task. No document-level state is kept.

Defined results: null sources, languages and tokenizers are groups of their own; a null text has 0 tokens; repeated rows
count each time; groups that fall to 0 documents and 0 tokens are left out of the totals; an empty batch commits and
changes nothing; other columns are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang", "tokenizer"]
_DELTAS = "batch string, attempt string, source string, lang string, tokenizer string, d_docs long, d_tokens long"
_COMMITS = "batch string, attempt string"

#: Tokenizer version -> what one token is, as a regular expression for whole texts.
TOKENIZERS = {"white-1": r"\S+", "alnum-2": r"[A-Za-z0-9]+|[^\sA-Za-z0-9]"}


def count_tokens(text: Column | str, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def changes(rows: DataFrame, sign: int, tokenizer: str, tokens: Column | str, source: str = "source", lang: str = "lang") -> DataFrame:
    """Signed change rows."""
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    return rows.select(F.col(source).alias("source"), F.col(lang).alias("lang"), F.lit(tokenizer).alias("tokenizer"), F.lit(sign).cast("long").alias("sign"), tokens.cast("long").alias("tokens"))


class TokenRollup:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _read(self, what: str, schema: str) -> DataFrame:
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{what}")
        if not fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(fs_path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{self.path}/{what}")

    def commits(self) -> DataFrame:
        return self._read("commits", _COMMITS).groupBy("batch").agg(F.min("attempt").alias("attempt"))

    def apply(self, batch: str, rows: DataFrame) -> bool:
        """Applies change rows (source, lang, tokenizer, sign, tokens) as the given batch; False if it was committed before."""
        if self.commits().where(F.col("batch") == batch).limit(1).count():
            return False
        attempt = uuid.uuid4().hex
        deltas = rows.groupBy(*KEYS).agg(F.sum("sign").alias("d_docs"), F.sum(F.col("sign") * F.coalesce("tokens", F.lit(0))).alias("d_tokens"))
        deltas.select(F.lit(batch).alias("batch"), F.lit(attempt).alias("attempt"), *KEYS, "d_docs", "d_tokens").write.parquet(f"{self.path}/deltas/{attempt}")
        self.spark.createDataFrame([(batch, attempt)], _COMMITS).coalesce(1).write.parquet(f"{self.path}/commits/{attempt}")
        return True

    def committed(self) -> DataFrame:
        return self._read("deltas", _DELTAS).join(self.commits(), ["batch", "attempt"], "left_semi")

    @staticmethod
    def _totals(deltas: DataFrame) -> DataFrame:
        sums = deltas.groupBy(*KEYS).agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens"))
        return sums.where((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens over all committed batches."""
        return self._totals(self.committed())

    def compact(self, path: str) -> TokenRollup:
        """A new rollup with the same totals and the same committed batch names, with one row per group in all."""
        to, attempt = TokenRollup(self.spark, path), uuid.uuid4().hex
        # The commits are read once: totals and names come from the same ones.
        self.commits().write.parquet(f"{path}/folded/{attempt}")
        folded = self.spark.read.schema(_COMMITS).parquet(f"{path}/folded/{attempt}")
        sums = self._totals(self._read("deltas", _DELTAS).join(folded, ["batch", "attempt"], "left_semi"))
        # The folded deltas are a batch named by their attempt, which no caller's batch is.
        sums.select(F.lit(attempt).alias("batch"), F.lit(attempt).alias("attempt"), *KEYS, F.col("n_docs").alias("d_docs"), F.col("n_tokens").alias("d_tokens")).write.parquet(f"{path}/deltas/{attempt}")
        done = self.spark.createDataFrame([(attempt, attempt)], _COMMITS)
        folded.select("batch", F.lit(attempt).alias("attempt")).unionByName(done).coalesce(1).write.parquet(f"{path}/commits/{attempt}")
        return to
