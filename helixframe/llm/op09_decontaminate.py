"""Operator 9: benchmark decontamination by template canonicalisation, with DataFrame functions alone.

Numbers, capitalised words inside a sentence (names) and units after numbers become typed placeholders; all else is
lower-cased words. Windows of `window` template words of the benchmark are hashed and joined to the windows of whole
texts. Matched windows on one diagonal (text place minus item place) are one alignment; it counts if its slots agree:
each value of the item stands for one value in the text and the other way round, as when a question is asked again with
other numbers. With Params.verbatim, windows whose values are the item's own always count. A document holds an item if the windows that count
are at least min_coverage of the item's windows.

Items without a window to look for, as they are shorter than one or placeholders fill more than half of each, are looked
for by value: the plain words of all their windows, or of the whole item where it is shorter. That is a scan of its own,
made only where there are such items. An item of fewer than min_words words is in too many texts to say anything and is not
looked for; unsought() lists such items.

The benchmark's windows are sent to every task while they are at most max_broadcast bytes; beyond that the join shuffles. The
texts are scanned once; only matched windows leave the scan, so a passage that many documents share costs a row per
match and no document group is gathered.

Defined results: null or empty texts hold nothing, and texts shorter than a window at most a shorter item; windows of
other items with placeholders in more than half of their words can't be told from chance and aren't looked for; items
of fewer than min_words words, none among them, are in no text;
repeated rows of a text or an item give their matches once per key (rows with equal keys are taken as one document);
null keys are left out; an empty table on either side gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that are units when they follow a number.
UNITS = (
    "km m cm mm kg g mg t l ml s ms h min hour hours minute minutes second seconds day days week weeks month months year years "
    "mile miles foot feet inch inches yard yards pound pounds ounce ounces litre litres liter liters metre metres meter meters "
    "percent dollar dollars cent cents euro euros usd eur gbp degree degrees"
).split()

MARK = "¤"
#: (pattern, replacement with \\1 for groups), in order; lower-casing stands between NAMES and WORDS.
DECIMALS = (r"([0-9])[.,]([0-9])", rf"\1{MARK}d\2")
NUMBERS = (rf"([0-9]+(?:{MARK}d[0-9]+)*)", rf" {MARK}n\1 ")
NAMES = (r"([\p{Ll},;] )(\p{Lu}\p{Ll}+)", rf"\1{MARK}a\2")
WORDS = (rf"[^\p{{L}}\p{{N}}{MARK}]+", " ")
PLAIN = (rf"{MARK}[nau]", "")
UNIT = (rf"({MARK}n[^ ]*) ({'|'.join(UNITS)}) ", rf"\1 {MARK}u\2 ")
SLOT = (rf"{MARK}([nau])[^ ]*", rf"{MARK}\1")


@dataclass(frozen=True)
class Params:
    """verbatim: windows with the item's own values count in alignments too whose slots disagree. min_words: the least words of an item that is looked for."""

    window: int = 8
    min_coverage: float = 0.5
    max_broadcast: int = 1 << 26
    verbatim: bool = False
    min_words: int = 4


def _sub(c: Column, rule: tuple[str, str]) -> Column:
    return F.regexp_replace(c, F.lit(rule[0]), F.lit(rule[1].replace("\\", "$")))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value computed once per row: a lambda's variable isn't copied when the plan's steps are merged."""
    return F.element_at(F.transform(F.array(value), body), 1)


def valued_words(text: Column) -> Column:
    """The text's words, with a space after each; slots keep their values behind the placeholder."""
    plain = F.translate(F.coalesce(text, F.lit("")), MARK, " ")
    numbered = let(plain, lambda t: F.when(t.rlike("[0-9]"), _sub(_sub(t, DECIMALS), NUMBERS)).otherwise(t))
    # neighbours share a letter, so the second pass takes every other name
    words = F.ltrim(_sub(F.concat(F.lower(_sub(_sub(numbered, NAMES), NAMES)), F.lit(" ")), WORDS))
    return let(words, lambda t: F.when(F.contains(t, F.lit(f"{MARK}n")), _sub(t, UNIT)).otherwise(t))


def windows(df: DataFrame, key: str, text: str, p: Params) -> DataFrame:
    """(key, s: struct of v, valued words; w, template words; hs, the hash of each window, null if there is none)."""

    def hashes(w: Column) -> Column:
        return F.when(F.size(w) >= p.window, F.transform(F.sequence(F.lit(1), F.size(w) - (p.window - 1)), lambda i: F.xxhash64(F.slice(w, i, p.window))))

    def parts(t: Column) -> Column:
        slots = F.when(F.contains(t, F.lit(MARK)), _sub(t, SLOT)).otherwise(t)
        return let(F.split(F.rtrim(slots), " "), lambda w: F.struct(F.split(F.rtrim(t), " ").alias("v"), w.alias("w"), hashes(w).alias("hs")))

    return df.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), let(valued_words(F.col(text)), parts).alias("s"))


def contaminated(docs: DataFrame, benchmark: DataFrame, params: Params = Params(), key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item, n_windows, n_matched, coverage) of documents that hold benchmark items."""
    p = params
    items = windows(benchmark, item, item_text, p).select(F.col("k").alias("item"), "s.v", "s.w", F.posexplode_outer("s.hs").alias("at", "h")).where("h is not null")
    items = items.withColumn("tw", F.slice("w", F.col("at") + 1, p.window)).where(F.size(F.filter("tw", lambda x: F.startswith(x, F.lit(MARK)))) * 2 <= p.window)
    items = items.select("item", "at", "h", F.slice("v", F.col("at") + 1, p.window).alias("iv")).dropDuplicates(["item", "at", "h"])
    sizes = items.groupBy("item").agg(F.countDistinct("at").alias("n_windows"))
    small = table_bytes(items, "iv") <= p.max_broadcast
    hint = F.broadcast if small else (lambda df: df)
    # (explode_outer, as a plain explode would compute all of this once more in a filter)
    texts = windows(docs, key, text, p)
    if small:
        found = texts.select("k", "s.v", F.posexplode_outer("s.hs").alias("place", "h")).join(F.broadcast(items.select("h", "item", "at", "iv")), "h")
    else:  # hashes alone are shuffled; the words of matched windows are fetched afterwards
        hits = texts.select("k", F.posexplode_outer("s.hs").alias("place", "h")).where("h is not null").hint("merge").join(items.select("h", "item", "at", "iv"), "h")
        same = F.xxhash64(F.slice("s.w", F.col("place") + 1, p.window)) == F.col("h")
        found = texts.hint("merge").join(hits, "k").where(same).select("k", "s.v", "place", "item", "at", "iv").distinct()
    found = found.select("k", "item", "at", (F.col("place") - F.col("at")).alias("diagonal"), F.slice("v", F.col("place") + 1, p.window).alias("dv"), "iv")
    slots = F.filter(F.arrays_zip("iv", "dv"), lambda x: F.startswith(x["iv"], F.lit(MARK)))
    # an alignment has at most one row per window of the item
    aligned = found.withColumn("slots", slots).groupBy("k", "item", "diagonal").agg(F.collect_set("at").alias("ats"), F.collect_set(F.when(F.col("iv") == F.col("dv"), F.col("at"))).alias("same"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("pairs"))
    n = F.size("pairs")
    agree = (F.size(F.array_distinct("pairs.iv")) == n) & (F.size(F.array_distinct("pairs.dv")) == n)
    aligned = aligned.withColumn("ats", F.when(agree, F.col("ats")).otherwise(F.col("same"))).where(F.size("ats") > 0) if p.verbatim else aligned.where(agree)
    held = aligned.groupBy("k", "item").agg(F.array_distinct(F.flatten(F.collect_set("ats"))).alias("ats"))
    held = held.join(hint(sizes), "item").select("k", "item", "n_windows", F.size("ats").cast("long").alias("n_matched"))
    by_value = value_matches(docs, benchmark, sizes, p, key, text, item, item_text)
    held = (held if by_value is None else held.unionByName(by_value)).withColumn("coverage", F.col("n_matched") / F.col("n_windows"))
    return held.where(F.col("coverage") >= p.min_coverage).select(F.col("k").alias(key), F.col("item").alias(item), "n_windows", "n_matched", "coverage")


def table_bytes(df: DataFrame, *arrays: str) -> int:
    """About how much memory a table of numbers and arrays of strings takes: 64 bytes a row, and 24 and its length for each string."""
    size = F.lit(64).cast("long")
    for a in arrays:
        size = size + F.aggregate(a, F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x) + 24)
    return df.agg(F.sum(size)).first()[0] or 0


def plain_words(df: DataFrame, key: str, text: str) -> DataFrame:
    """(k, v): the words of each text without placeholders, none for a text without words; rows with null keys are left out."""
    words = let(F.rtrim(_sub(valued_words(F.col(text)), PLAIN)), lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, " ")))
    return df.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), words.alias("v"))


def unsought(benchmark: DataFrame, params: Params = Params(), item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item, n_words) of the items that are too short to be looked for."""
    return plain_words(benchmark, item, item_text).groupBy(F.col("k").alias(item)).agg(F.max(F.size("v")).alias("n_words")).where(F.col("n_words") < params.min_words)


def value_matches(docs: DataFrame, benchmark: DataFrame, sizes: DataFrame, p: Params, key: str, text: str, item: str, item_text: str) -> DataFrame | None:
    """(k, item, n_windows, n_matched) by plain words, of the items that `sizes` doesn't hold; None where there is none."""

    def hashes(v: Column, length: Column) -> Column:
        return F.when(F.size(v) >= length, F.transform(F.sequence(F.lit(1), F.size(v) - length + 1), lambda i: F.xxhash64(F.slice(v, i, length))))

    items = plain_words(benchmark, item, item_text).withColumnRenamed("k", "item").where(F.size("v") >= p.min_words).join(sizes, "item", "left_anti")
    items = items.withColumn("length", F.least(F.size("v"), F.lit(p.window)))
    items = items.select("item", "length", F.posexplode(hashes(F.col("v"), F.col("length"))).alias("at", "h")).dropDuplicates(["item", "at", "h"])
    lengths = [r[0] for r in items.select("length").distinct().orderBy("length").collect()]  # at most p.window
    if not lengths:
        return None
    hint = F.broadcast if table_bytes(items) <= p.max_broadcast else (lambda df: df)
    each = lambda v: F.array_distinct(F.concat(*[F.coalesce(hashes(v, F.lit(n)), F.array().cast("array<bigint>")) for n in lengths]))
    texts = plain_words(docs, key, text).select("k", F.explode_outer(let(F.col("v"), each)).alias("h"))
    n_windows = items.groupBy("item").agg(F.countDistinct("at").alias("n_windows"))
    met = texts.join(hint(items.select("h", "item", "at")), "h").groupBy("k", "item").agg(F.countDistinct("at").alias("n_matched"))
    return met.join(hint(n_windows), "item").select("k", "item", "n_windows", "n_matched")


def oracle(p: Params = Params(verbatim=True)) -> str:
    """The same in DuckDB's SQL."""
    window = p.window

    def sub(expr: str, rule: tuple[str, str]) -> str:
        return f"regexp_replace({expr}, '{rule[0]}', '{rule[1]}', 'g')"

    t = sub(sub(sub(sub(f"replace(coalesce(text, ''), '{MARK}', ' ')", DECIMALS), NUMBERS), NAMES), NAMES)
    t = sub(f"ltrim({sub(f'lower({t}) || chr(32)', WORDS)})", UNIT)
    side = lambda table, key: f"SELECT {key} AS k, {t} AS t FROM {table} WHERE {key} IS NOT NULL"
    slots = lambda x: f"SELECT k, v, w FROM (SELECT k, string_split(rtrim(t), ' ') AS v, string_split(rtrim({sub('t', SLOT)}), ' ') AS w FROM {x}) WHERE len(v) >= {window}"
    plain = lambda x: f"SELECT k, string_split(rtrim({sub('t', PLAIN)}), ' ') AS v FROM {x} WHERE rtrim({sub('t', PLAIN)}) <> ''"
    cut = lambda x: f"SELECT k, place, array_to_string(list_slice(w, place + 1, place + {window}), ' ') AS tw, list_slice(v, place + 1, place + {window}) AS vw FROM (SELECT *, unnest(range(0, len(w) - {window - 1})) AS place FROM {x})"
    counts = "bad.k IS NULL OR iv = dv" if p.verbatim else "bad.k IS NULL"
    return f"""
WITH dt AS MATERIALIZED ({side("documents", "doc_id")}), bt AS MATERIALIZED ({side("benchmark", "item_id")}), d AS ({slots("dt")}), b AS ({slots("bt")}),
bw AS (SELECT * FROM ({cut("b")}) WHERE 2 * (length(tw) - length(replace(tw, '{MARK}', ''))) <= {window}),
dw AS ({cut("d")}),
sizes AS (SELECT k AS item, count(DISTINCT place) AS n_windows FROM bw GROUP BY k),
hits AS (SELECT dw.k, bw.k AS item, bw.place, dw.place - bw.place AS diagonal, bw.vw AS iv, dw.vw AS dv FROM dw JOIN bw ON dw.tw = bw.tw),
slots AS (
  SELECT k, item, diagonal, iv, dv FROM (SELECT k, item, diagonal, unnest(iv) AS iv, unnest(dv) AS dv FROM hits) WHERE starts_with(iv, '{MARK}')
), bad AS (
  SELECT k, item, diagonal FROM slots GROUP BY ALL HAVING count(DISTINCT iv) <> count(DISTINCT iv || ' ' || dv) OR count(DISTINCT dv) <> count(DISTINCT iv || ' ' || dv)
), held AS (
  SELECT h.k, h.item, count(DISTINCT place) AS n_matched FROM hits h LEFT JOIN bad ON h.k = bad.k AND h.item = bad.item AND h.diagonal = bad.diagonal
  WHERE {counts} GROUP BY h.k, h.item
), pd AS ({plain("dt")}),
pi AS (SELECT k AS item, v, least(len(v), {window}) AS n FROM ({plain("bt")}) WHERE len(v) >= {p.min_words} AND k NOT IN (SELECT item FROM sizes)),
iw AS (SELECT DISTINCT item, n, at_, array_to_string(list_slice(v, at_ + 1, at_ + n), ' ') AS words FROM (SELECT *, unnest(range(0, len(v) - n + 1)) AS at_ FROM pi)),
pw AS (
  SELECT DISTINCT k, n, array_to_string(list_slice(v, at_ + 1, at_ + n), ' ') AS words
  FROM (SELECT k, v, n, unnest(range(0, len(v) - n + 1)) AS at_ FROM pd, (SELECT DISTINCT n FROM iw) WHERE len(v) >= n)
), told AS (
  SELECT k, item, n_windows, n_matched FROM held JOIN sizes USING (item)
  UNION ALL SELECT k, iw.item, any_value(s.n_windows), count(DISTINCT at_) FROM pw JOIN iw ON pw.n = iw.n AND pw.words = iw.words
  JOIN (SELECT item, count(DISTINCT at_) AS n_windows FROM iw GROUP BY item) s ON s.item = iw.item GROUP BY k, iw.item
)
SELECT k AS doc_id, item AS item_id, n_windows, n_matched, n_matched / n_windows AS coverage FROM told WHERE n_matched / n_windows >= {p.min_coverage}
"""
