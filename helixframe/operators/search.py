"""Text and vector search."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.sinks import KeyedTable


def terms(text: Column | str) -> Column:
    """Lower-cased letter-digit terms."""
    c = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda x: x != "")


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(term, key, tf, length): the inverted table (K8)."""
    flat = docs.select(key, terms(text).alias("ts")).select(key, F.size("ts").alias("length"), F.explode("ts").alias("term"))
    return flat.groupBy("term", key, "length").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame, key: str, text: str, n: int = 100, k1: float = 1.2, b: float = 0.75, max_broadcast: int = 500_000) -> DataFrame:
    """(query, key, score, rank): the n best documents of each query that hold any of its terms.

    queries: (query, text). While their terms are at most max_broadcast they are sent to every task, so a document's other
    terms are dropped before anything is shuffled; beyond that the joins shuffle. Lengths and document frequencies are
    over all documents.
    """
    asked = queries.select("query", F.explode(F.array_distinct(terms("text"))).alias("term"))
    hint = F.broadcast if asked.count() <= max_broadcast else (lambda df: df)  # terms are words: a bound in rows is one in bytes, but for freaks
    split = docs.select(key, terms(text).alias("ts"))
    stats = split.agg(F.count("*").alias("n_docs"), F.avg(F.size("ts")).alias("mean"))
    hit = split.select(key, F.size("ts").alias("length"), F.explode("ts").alias("term")).join(hint(asked.select("term").distinct()), "term")
    tf = hit.groupBy("term", key, "length").agg(F.count("*").alias("tf"))
    return _scored(tf, tf.groupBy("term").agg(F.count("*").alias("df")), stats, asked, key, n, k1, b, hint)


def _scored(tf: DataFrame, df: DataFrame, stats: DataFrame, asked: DataFrame, key: str, n: int, k1: float, b: float, hint) -> DataFrame:
    """(query, key, score, rank) from the asked terms' postings, their document frequencies, and one row of statistics."""
    idf = df.crossJoin(stats).select("term", "mean", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))  # one row of statistics
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    scored = tf.join(hint(idf), "term").join(hint(asked), "term").groupBy("query", key).agg(F.round(F.sum(part), 6).alias("score"))
    w = Window.partitionBy("query").orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


class TextIndex:
    """Postings that follow upserts and deletes of documents, and bm25 that reads the asked terms alone.

    Three keyed tables: the postings of a document, with their terms' hash range as a folder, so that a query reads the
    ranges of its terms; document frequencies and counts as signed deltas, added up where they are asked for. A batch is
    applied once, whatever its retries: every table knows the batch's number.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "doc_id", kind: str = "long", ranges: int = 64):
        self.spark, self.path, self.key, self.kind, self.ranges = spark, path.rstrip("/"), key, kind, ranges
        self.live = KeyedTable(spark, f"{self.path}/live", f"{key} {kind}, length int, terms array<string>, batch long", key)

    def _range(self, term: str) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.ranges)).cast("int")

    def apply(self, batch: int, upserts: DataFrame | None = None, deletes: DataFrame | None = None, text: str = "text") -> None:
        """Texts that come (key, text) or go (key). Keys of a batch are unique; a key of both goes and comes again."""
        key = self.key
        new = None if upserts is None else upserts.select(key, terms(text).alias("ts")).select(key, F.size("ts").alias("length"), F.col("ts").alias("terms"))
        touched = new.select(key) if new is not None else None
        if deletes is not None:
            touched = deletes.select(key) if touched is None else touched.unionByName(deletes.select(key))
        if self.live.batches() and self.live.last_batch() >= batch:
            return
        # what goes is what lives before this batch; its postings come back with a minus
        old = self.live.read().join(touched.distinct(), key, "left_semi").select(key, "length", "terms", F.lit(-1).alias("sign"))
        both = old if new is None else old.unionByName(new.withColumn("sign", F.lit(1)))
        flat = both.select(key, "length", "sign", F.explode("terms").alias("term")).groupBy("term", key, "length", "sign").agg(F.count("*").alias("tf"))
        flat.withColumn("range", self._range("term")).repartition("range").sortWithinPartitions("range", "term").write.mode("overwrite").partitionBy("range").parquet(f"{self.path}/postings/batch={batch}")
        both.agg(F.coalesce(F.sum("sign"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum(F.col("sign") * F.col("length")), F.lit(0)).alias("n_terms")).write.mode("overwrite").parquet(f"{self.path}/totals/batch={batch}")
        self.live.merge(upserts=None if new is None else new.withColumn("batch", F.lit(batch).cast("long")), deletes=deletes, batch=batch)

    def _whole(self, what: str, schema: str) -> DataFrame:
        """The rows of the batches that were committed."""
        return self.spark.read.schema(schema).parquet(f"{self.path}/{what}").where(F.col("batch") <= self.live.last_batch())

    def postings(self, asked: list[str]) -> DataFrame:
        """(term, key, length, tf) of the terms: the ranges that hold them are read, no others."""
        hashed = self.spark.createDataFrame([(t,) for t in asked], "term string").select("term", self._range("term").alias("r"))
        mine = sorted({r["r"] for r in hashed.collect()})  # at most `ranges` numbers
        rows = self._whole("postings", f"batch long, range int, term string, {self.key} {self.kind}, length int, sign int, tf long")
        rows = rows.where(F.col("range").isin(mine)).where(F.col("term").isin(asked))
        return rows.groupBy("term", self.key, "length").agg(F.sum(F.col("sign") * F.col("tf")).alias("tf")).where("tf > 0")

    def totals(self) -> DataFrame:
        """(n_docs, mean): how many documents there are, and their mean number of terms."""
        t = self._whole("totals", "batch long, n_docs long, n_terms long")
        return t.agg(F.sum("n_docs").alias("n_docs"), (F.sum("n_terms") / F.sum("n_docs")).alias("mean"))

    def bm25(self, queries: DataFrame, n: int = 100, k1: float = 1.2, b: float = 0.75, most_terms: int = 100_000) -> DataFrame:
        """(query, key, score, rank) as bm25() gives over the live documents' texts. queries: (query, text); at most most_terms different terms."""
        asked = queries.select("query", F.explode(F.array_distinct(terms("text"))).alias("term"))
        wanted = [r[0] for r in asked.select("term").distinct().limit(most_terms + 1).collect()]
        if len(wanted) > most_terms:
            raise ValueError(f"more than {most_terms} terms: search texts with bm25()")
        tf = self.postings(wanted)
        return _scored(tf, tf.groupBy("term").agg(F.count("*").alias("df")), self.totals(), asked, self.key, n, k1, b, F.broadcast)


def symbol_search(docs: DataFrame, symbol: str, column: str = "symbol") -> DataFrame:
    """Exact keyword match, upper-cased."""
    return docs.where(F.col(column) == symbol.upper())


def combined(symbol_hits: DataFrame, label_hits: DataFrame) -> DataFrame:
    """Symbol hits, then label hits; duplicates stay (T4)."""
    return symbol_hits.withColumn("source_rank", F.lit(0)).unionByName(label_hits.withColumn("source_rank", F.lit(1)))


class _Best:
    """The best groups of each query among the vectors that a task has seen: k of them, and those that tie with the last."""

    def __init__(self, k: int):
        self.k = k
        self.held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def add(self, at: tuple[int, int], groups: np.ndarray, scores: np.ndarray) -> None:
        """groups: codes of groups, scores: of vectors of these groups, for one query."""
        if at in self.held:
            groups, scores = np.concatenate((self.held[at][0], groups)), np.concatenate((self.held[at][1], scores))
        order = np.lexsort((-scores, ~np.isnan(scores), groups))  # NaN is the largest, as in SQL
        groups, scores = groups[order], scores[order]
        first = np.concatenate(([True], groups[1:] != groups[:-1]))  # a group's best vector
        groups, scores = groups[first], scores[first]
        if len(groups) > self.k:
            least = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            keep = np.isnan(scores) | (scores >= least - 2e-6)  # scores are told to six digits: what may tie stays
            groups, scores = groups[keep], scores[keep]
        self.held[at] = groups, scores


def nearest(vectors: DataFrame, queries: DataFrame, key: str, vector: str, group: str, k: int = 5, block: int = 4_096) -> DataFrame:
    """(query, group, score, rank): the k groups whose best vector has the largest dot product with the query (T5).

    Up to `block` queries are sent to every task; a task multiplies matrices and keeps the k best groups per query over all
    its vectors: a group among the k best of all is among the k best of the task that holds its best vector. So what is
    shuffled grows with tasks, queries and k, not with vectors or groups. More queries, up to all rows, are dealt with the
    vectors into cells (see _in_cells). Vectors of other lengths than the query's, null ones and ones with null components
    have no score.
    """
    n_queries = queries.count()
    search = _by_broadcast if n_queries <= block else partial(_in_cells, n_queries=n_queries, block=block)
    found = search(_whole_vectors(vectors, group, vector, "g", "v"), _whole_vectors(queries, key, vector, "query", "q"), k)
    total = found.groupBy("query", F.col("g").alias(group)).agg(F.round(F.max("score"), 6).alias("score"))
    w = Window.partitionBy("query").orderBy(F.desc("score"), group)
    return total.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _whole_vectors(df: DataFrame, name: str, vector: str, as_name: str, as_vector: str) -> DataFrame:
    """(name, vector) of the vectors that are not null and have no null components; floats stay floats, others become doubles."""
    kind = "array<float>" if dict(df.dtypes)[vector] == "array<float>" else "array<double>"
    rows = df.where(F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull()))
    return rows.select(F.col(name).alias(as_name), F.col(vector).cast(kind).alias(as_vector))


def _by_broadcast(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query, g, score): for each task and query the k best groups, from (g, v) and at most a block of (query, q)."""
    kinds = dict(rows.dtypes) | dict(asked.dtypes)
    by_length = {}
    for r in asked.select(F.col("query").cast("string"), F.col("q").cast("array<double>")).collect():  # at most a block
        by_length.setdefault(len(r["q"]), ([], []))[0].append(r["query"])
        by_length[len(r["q"])][1].append(r["q"])
    shared = rows.sparkSession.sparkContext.broadcast({n: (names, np.array(q)) for n, (names, q) in by_length.items()})

    def best(frames):
        top, codes, names_of = _Best(k), {}, []
        for pdf in frames:
            own = [None if pd.isna(g) else g for g in pdf["g"]]
            for g in own:
                if g not in codes:
                    codes[g] = len(names_of)
                    names_of.append(g)
            code = np.array([codes[g] for g in own], np.int64)
            sizes = pdf["v"].map(len).to_numpy()
            for n, (_, q) in shared.value.items():
                some = np.flatnonzero(sizes == n)
                if len(some):
                    score = np.stack(pdf["v"].to_numpy()[some]) @ q.T
                    for j in range(score.shape[1]):
                        top.add((n, j), code[some], score[:, j])
            used = {c for groups, _ in top.held.values() for c in groups.tolist()}
            if len(codes) > 4 * len(used) + 10_000:  # names of groups that no query holds any more
                again = {c: i for i, c in enumerate(sorted(used))}
                names_of = [names_of[c] for c in sorted(used)]
                codes = {g: i for i, g in enumerate(names_of)}
                top.held = {at: (np.array([again[c] for c in groups.tolist()], np.int64), scores) for at, (groups, scores) in top.held.items()}
        for (n, j), (groups, scores) in top.held.items():
            yield pd.DataFrame({"query": shared.value[n][0][j], "g": pd.Series([names_of[c] for c in groups.tolist()], dtype=object), "score": scores})

    kind = "string" if kinds["g"] == "bigint" else kinds["g"]  # pandas has long integers beside nulls as floats, and NaN as null
    scored = rows.select(F.col("g").cast(kind), F.col("v").cast("array<double>")).mapInPandas(best, f"query string, g {kind}, score double")
    return scored.select(F.col("query").cast(kinds["query"]), F.col("g").cast(kinds["g"]), F.coalesce("score", F.lit(float("nan"))).alias("score"))


def _in_cells(rows: DataFrame, asked: DataFrame, k: int, n_queries: int, block: int) -> DataFrame:
    """(query, g, score): for each cell and query the k best groups, from (g, v) and any number of (query, q).

    Vectors and queries are dealt by hash into blocks, each vector block meets each query block in one cell, and a cell is
    one product of matrices: nothing passes through the driver, and a cell's size is bounded. Equal rows say nothing new
    and are dropped first, so no block is hot. All pairs are multiplied: rows times queries in work, rows times query
    blocks and queries times vector blocks in shuffle.
    """
    kinds = dict(rows.dtypes) | dict(asked.dtypes)
    rows, asked = rows.distinct(), asked.distinct()
    n_rows, length = rows.agg(F.count("*"), F.avg(F.size("v"))).first()
    block = max(1, int(block * 64 / max(64, length or 0)))  # long vectors make fewer rows of a cell
    over = max(1, -(-n_rows // (8 * block)))
    down = max(-(-n_queries // (4 * block)), -(-3 * rows.sparkSession.sparkContext.defaultParallelism // over))  # some cells for each core
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n, *by: F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")
    left = asked.withColumn("down", dealt(down, "query", "q")).withColumn("over", each(over))
    right = rows.withColumn("over", dealt(over, "g", "v")).withColumn("down", each(down))
    return left.groupBy("down", "over").cogroup(right.groupBy("down", "over")).applyInArrow(lambda q, v: _cell(q, v, k), f"query {kinds['query']}, g {kinds['g']}, score double")


def _cell(asked: pa.Table, rows: pa.Table, k: int, at_once: int = 1 << 22) -> pa.Table:
    """(query, g, score): the k best groups of each query among the rows, and those that tie with the last. At most about at_once scores are held."""
    names, g = asked["query"].combine_chunks(), rows["g"].combine_chunks().dictionary_encode(null_encoding="encode")
    q, v = asked["q"].combine_chunks(), rows["v"].combine_chunks()
    q_sizes, v_sizes = (np.asarray(pc.list_value_length(x)) for x in (q, v))
    found = [(names[:0], g.dictionary[:0], pa.array([], pa.float64()))]
    for n in np.unique(q_sizes):
        mine, code = np.flatnonzero(q_sizes == n), np.asarray(g.indices)
        some = np.flatnonzero(v_sizes == n)
        if not len(some):
            continue
        some = some[np.argsort(code[some], kind="stable")]
        code = code[some]
        first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
        matrix = lambda x, at: x.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), n)  # noqa: E731, B023
        x, y = matrix(q, mine), matrix(v, some).T
        step = max(1, at_once // len(some))
        for a in range(0, len(mine), step):
            score = np.maximum.reduceat(x[a : a + step] @ y, first, axis=1)  # of groups; NaN is the largest, as in SQL
            keep = np.ones(score.shape, bool)
            if len(first) > k:
                least = np.partition(score, len(first) - k, axis=1)[:, [len(first) - k]]
                keep = np.isnan(score) | (score >= least - 2e-6)  # scores are told to six digits: what may tie stays
            i, j = np.nonzero(keep)
            found.append((names.take(pa.array(mine[a + i])), g.dictionary.take(pa.array(code[first[j]])), pa.array(score[keep])))
    return pa.table([pa.concat_arrays(x) for x in zip(*found, strict=True)], ["query", "g", "score"])


def embed(docs: DataFrame, key: str, text: str, model: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """(key, vector): texts through a user's model in batches, normalised to length 1."""

    def run(frames):
        for pdf in frames:
            x = np.asarray(model(pdf[text].fillna("").tolist()), np.float32)
            yield pd.DataFrame({key: pdf[key], "raw": list(x)})

    kind = dict(docs.dtypes)[key]
    raw = docs.select(key, text).mapInPandas(run, f"{key} {kind}, raw array<float>")
    norm = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return raw.withColumn("norm", norm).select(key, F.transform("raw", lambda x: F.when(F.col("norm") > 0, (x / F.col("norm")).cast("float")).otherwise(x)).alias("vector"))
