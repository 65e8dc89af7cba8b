"""Operator 4: language identification by compression with per-language zstandard dictionaries.

Whole learnt texts are cut into passages of passage_chars characters; of each language's distinct passages a bounded
number, those with the smallest hashes, becomes one raw-content dictionary. A text is cut into blocks of block_chars
characters; each block's letters (lower-cased, runs of anything else as one space) are compressed with every language's
dictionary, and a language's size is the sum over all blocks of the whole text. The language with the smallest size
wins. Blocks keep a long text from becoming its own dictionary. A text is rejected when its margin, the gap to the
second size divided by the second size, is narrower than min_margin, or when it has no letters.

score = 1 / (1 + sum over the other languages of exp(-sharpness * gap / smallest size)): 1 when far ahead, 1/n when all tie.

Defined results: null texts and texts without a letter (numerals such as Roman or circled ones are none) are `und`,
score 0, rejected; ties go to the language with more learnt rows, then the first in alphabetical order (and are
rejected, their margin being 0); very long texts are compressed whole, block by block; repeated rows give repeated
results; with no learnt language every text is `und`; the dictionaries of all languages together are bounded (Params.max_bytes); an empty table gives an empty result; other columns pass through, except those that bear a result
column's name, which are replaced.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, use_table, with_text_columns

_NOT_LETTERS = re.compile(r"[\W\d_]+")


@dataclass(frozen=True)
class Params:
    """passages per language and their length bound what is learnt from each language: passages * passage_chars characters.

    max_bytes bounds all dictionaries together, which every task is sent: where there are so many languages that it would
    not hold, each learns fewer passages (of the default, 256 up to 85 languages and one up to 21,845); more languages
    than that are an error.
    """

    passages: int = 256
    passage_chars: int = 768
    block_chars: int = 4096
    level: int = 6
    min_match: int = 3
    min_margin: float = 0.01
    sharpness: float = 40.0
    max_bytes: int = 1 << 26


def letters(text: str) -> str:
    """Lower-cased words with one space between them; empty if no character is a letter."""
    clean = _NOT_LETTERS.sub(" ", text.lower()).strip()
    return clean if any(map(str.isalpha, clean)) else ""


def fit(docs: DataFrame, params: Params = Params(), text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """One dictionary per non-null language, in descending order of rows.

    Keys play no part: rows with null or repeated keys are learnt from like others, and repeated passages are one.
    """
    p = params
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("l"), F.col(text).alias("t"))
    rows = rows.select("l", F.posexplode(F.regexp_extract_all("t", F.lit(f"(?s).{{1,{p.passage_chars}}}"), F.lit(0))).alias("place", "t"))
    rows = rows.where(F.col("t").rlike(r"\p{L}")).select("l", "place", "t", F.xxhash64("t").alias("h"))
    learnt = stored(rows.groupBy("l").agg(F.count(F.when(F.col("place") == 0, 1)).alias("count"), F.approx_count_distinct("h").alias("passages")), "languages")
    most = p.max_bytes // (4 * p.passage_chars * max(1, learnt.count()))  # a character takes four bytes at most
    if most < 1:
        raise ValueError(f"dictionaries of {learnt.count()} languages take more than {p.max_bytes} bytes")
    wanted = min(p.passages, most)
    # About four times the wanted passages of each language lie below its hash bound; of those, ranked, the first are taken.
    share = F.pmod("h", F.lit(1 << 40)) / float(1 << 40)
    near = rows.join(learnt.select("l", ((4 * wanted + 64) / F.col("passages")).alias("bound")), "l").where(share < F.col("bound")).groupBy("l", "h").agg(F.min("t").alias("t"))
    order = Window.partitionBy("l").orderBy(F.pmod("h", F.lit(1 << 40)), "h")
    chosen = near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= wanted)
    out: dict[str, list[str]] = {}
    for r in chosen.orderBy("l", F.desc("r")).collect():  # at most `wanted` rows a language
        out.setdefault(r["l"], []).append(letters(r["t"]))
    names = [r["l"] for r in learnt.orderBy(F.desc("count"), "l").collect()]
    return {name: "\n".join(out[name]).encode() for name in names if name in out}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], params: Params = Params()):
        self.p = params
        self.names = [k for k, v in dictionaries.items() if v.strip()]
        self.compressors = []
        for k in self.names:
            how = zstandard.ZstdCompressionParameters.from_level(params.level, source_size=params.block_chars, dict_size=len(dictionaries[k]), min_match=params.min_match, write_content_size=False, write_checksum=False, write_dict_id=False)
            d = zstandard.ZstdCompressionDict(dictionaries[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=how)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=d, compression_params=how))

    def judge(self, text: str | None) -> tuple[str, float, float]:
        """Language, score and margin."""
        clean = letters(text) if text else ""
        if not clean or not self.names:
            return "und", 0.0, 0.0
        n = self.p.block_chars
        blocks = [clean[i : i + n].encode() for i in range(0, len(clean), n)]
        sizes = [sum(len(c.compress(b)) for b in blocks) for c in self.compressors]
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        best = sizes[order[0]]
        rest = [sizes[i] for i in order[1:]]
        score = 1 / (1 + sum(math.exp(-self.p.sharpness * (s - best) / best) for s in rest))
        return self.names[order[0]], score, (rest[0] - best) / rest[0] if rest else 1.0


def predict(docs: DataFrame, dictionaries: dict[str, bytes], params: Params = Params(), text: str = "text", out: str = "lang_pred", score: str = "score", rejected: str = "rejected") -> DataFrame:
    """docs with the predicted language, its score and whether it is rejected. Params bounds each dictionary."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def make():
        use_table("dictionaries")  # none is kept; those of other operators are emptied
        judge = Classifier(shared.value, params).judge

        def run(texts):
            got = [judge(t) for t in texts]
            return [[g[0] for g in got], [g[1] for g in got], [g[2] < params.min_margin for g in got]]

        return run

    return with_text_columns(docs, text, make, [T.StructField(out, T.StringType()), T.StructField(score, T.DoubleType()), T.StructField(rejected, T.BooleanType())])
