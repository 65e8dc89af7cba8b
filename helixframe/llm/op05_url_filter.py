"""Operator 5: URL filters on a sorted digest array.

Rules (a host with all its subdomains, a path prefix, a verdict) are kept in one file: the sorted 64-bit xxhash digests
of the rule strings host/path, an offset table, and the strings. The file is written to the shared folder, goes to
every executor with addFile and is memory-mapped there. A url asks for each host suffix joined to each path prefix of a
length that some rule has; all questions of a batch are one vectorised binary search, and every hit is confirmed against
the stored full string, so a digest collision costs a comparison and never a wrong verdict. The longest rule that fits
wins.

Rules of more than max_bytes in all are not gathered: the same questions are then probed by an equi-join on the digest,
with the same results. judge() chooses by the rules' size.

Defined results: a url that is null or has no `://` has an empty host and path, no rule and the default verdict; an empty
rule list gives every url the default verdict; very long urls are judged whole; repeated urls get equal verdicts; for
equal rules the verdict that is first in alphabetical order holds; an empty table gives an empty result; other columns
pass through, except those that bear a result column's name, which are replaced.
"""

from __future__ import annotations

import mmap
import os
import re
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import open_fs, with_text_columns, work_dir

_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_UPPER = {i: i + 32 for i in range(65, 91)}
MAX_BYTES = 1 << 28


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str  # with its leading slash

    @property
    def text(self) -> str:
        return self.host + self.path


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    m = _URL.search(url) if url else None
    return (m[1].translate(_UPPER), m[2]) if m else ("", "")


class DigestFile:
    """The arrays of a rule list in one memory-mapped file: digests, offsets, strings (each behind its verdict and a zero byte)."""

    @staticmethod
    def pack(rules: list[Rule]) -> bytes:
        verdicts: dict[str, str] = {}
        for r in rules:
            verdicts[r.text] = min(r.verdict, verdicts.get(r.text, r.verdict))
        raw = {s: s.encode("utf-8", "surrogatepass") for s in verdicts}
        digests = np.array([xxhash.xxh64_intdigest(raw[s]) for s in verdicts], "<u8")
        order = np.argsort(digests, kind="stable")
        strings = [v.encode() + b"\0" + raw[s] for s, v in verdicts.items()]
        strings = [strings[i] for i in order]
        paths = sorted({len(r.path) for r in rules})
        head = np.array([len(verdicts), len(paths), *paths], "<u8").tobytes()
        return head + digests[order].tobytes() + np.cumsum([0, *map(len, strings)]).astype("<u8").tobytes() + b"".join(strings)

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        n, k = np.frombuffer(self.map, "<u8", 2).tolist()
        self.path_lengths = np.frombuffer(self.map, "<u8", k, 16).tolist()
        at = 16 + 8 * k
        self.digests = np.frombuffer(self.map, "<u8", n, at)
        self.offsets = np.frombuffer(self.map, "<u8", n + 1, at + 8 * n)
        self.base = at + 8 * n + 8 * (n + 1)

    def judge(self, parts: list[tuple[str, str]]) -> list[tuple[str, str] | None]:
        """Rule string and verdict of the longest fitting rule of each (host, path)."""
        asked, owner = [], []
        for i, (host, path) in enumerate(parts):
            labels = host.split(".")
            for j in range(len(labels)):
                suffix = ".".join(labels[j:])
                for n in self.path_lengths:
                    if n > len(path):
                        break
                    asked.append(suffix + path[:n])
                    owner.append(i)
        raw = [s.encode("utf-8", "surrogatepass") for s in asked]
        digests = np.fromiter(map(xxhash.xxh64_intdigest, raw), np.uint64, len(raw))
        at = np.searchsorted(self.digests, digests)
        out: list[tuple[str, str] | None] = [None] * len(parts)
        inside = at < len(self.digests)
        hits = np.flatnonzero(inside)[self.digests[at[inside]] == digests[inside]]
        for h in hits.tolist():
            k = int(at[h])
            while k < len(self.digests) and self.digests[k] == digests[h]:  # digests can collide: compare the strings
                stored = self.map[self.base + int(self.offsets[k]) : self.base + int(self.offsets[k + 1])]
                verdict, _, rule = stored.partition(b"\0")
                if rule == raw[h]:
                    best = out[owner[h]]
                    if best is None or len(asked[h]) > len(best[0]):
                        out[owner[h]] = asked[h], verdict.decode()
                    break
                k += 1
        return out


_OPEN: dict[str, DigestFile] = {}  # the file last used
RESULT = ("host", "path", "rule", "verdict")


def judge(urls: DataFrame, rules: list[Rule] | DataFrame, url: str = "url", default: str = "allow", max_bytes: int = MAX_BYTES) -> DataFrame:
    """urls with host, path, rule (null: none fits) and verdict. rules: a list, or a table (host, path, verdict) of any size."""
    spark = urls.sparkSession
    if isinstance(rules, DataFrame):
        rules = rules.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("host", "path", "verdict")))
        size = rules.agg(F.sum(F.octet_length(F.concat("host", "path", "verdict")) + 64)).first()[0] or 0
        if size > max_bytes:
            return judge_by_join(urls, rules, url, default)
        rules = [Rule(r["verdict"], r["host"], r["path"]) for r in rules.toLocalIterator()]
    elif sum(len(r.text) + len(r.verdict) + 64 for r in rules) > max_bytes:
        return judge_by_join(urls, spark.createDataFrame([(r.host, r.path, r.verdict) for r in rules], "host string, path string, verdict string"), url, default)
    uri = work_dir(spark, "url-rules")
    fs, path = open_fs(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    with fs.open_output_stream(path) as out:
        out.write(DigestFile.pack(rules))
    spark.sparkContext.addFile(uri)
    name = os.path.basename(path)

    def make():
        if name not in _OPEN:
            _OPEN.clear()
            _OPEN[name] = DigestFile(SparkFiles.get(name))
        table = _OPEN[name]

        def run(texts):
            parts = [split_url(u) for u in texts]
            got = table.judge(parts)
            return [[p[0] for p in parts], [p[1] for p in parts], [g and g[0] for g in got], [g[1] if g else default for g in got]]

        return run

    return with_text_columns(urls, url, make, [T.StructField(c, T.StringType()) for c in RESULT])


def judge_by_join(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """judge() by an equi-join: candidates of distinct (host, path) pairs meet the rules on the digest and are confirmed on the string."""
    kept = [c for c in urls.columns if c not in RESULT or c == url]
    parts = urls.select(*kept).withColumns({
        "_host": F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
        "_path": F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1),
    })
    # one row: the distinct lengths of rule paths
    lengths = F.broadcast(rules.select(F.length("path").alias("n")).distinct().agg(F.sort_array(F.collect_set("n")).alias("ns")))
    labels = F.split("_host", "\\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = parts.select("_host", "_path").distinct().join(lengths).withColumn("h", F.explode(hosts)).withColumn("n", F.explode("ns")).where(F.col("n") <= F.length("_path"))
    asked = asked.withColumn("s", F.concat("h", F.substring("_path", F.lit(1), F.col("n")))).withColumn("d", F.xxhash64("s"))
    known = rules.select(F.concat("host", "path").alias("s"), "verdict").groupBy("s").agg(F.min("verdict").alias("v")).withColumn("d", F.xxhash64("s"))
    first = Window.partitionBy("_host", "_path").orderBy(F.desc(F.length("s")))
    found = asked.join(known, ["d", "s"]).withColumn("r", F.row_number().over(first)).where("r = 1").select("_host", "_path", "s", "v")
    joined = parts.join(found, ["_host", "_path"], "left")
    own = [c for c in kept if c not in RESULT]
    return joined.select(*own, F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("s").alias("rule"), F.coalesce("v", F.lit(default)).alias("verdict"))
