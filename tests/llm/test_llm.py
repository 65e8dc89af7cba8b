"""The numbered operators and the pipeline: brute force, round trips, held-out accuracy, hostile rows."""

import collections
import hashlib
import io
import math
import random
import re
import string
import unicodedata
import zipfile
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from xxhash import xxh3_64_intdigest as xxh

import corpus_pipeline
from helixframe.llm import blocks, op01_embedding_dedup, op02_toxicity, op03_token_counts, op04_language, op05_url_filter, op06_warc_zip, op07_ngram_join, op08_token_files, op09_decontaminate, op10_bpe, queries
from helixframe.llm.common import work_dir

SF = "/root/testdata/sf0.001"
VOCAB = queries.VOCABULARY
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, host string, ids string, h long"


def hostile(spark):
    """Nulls anywhere, empty and very long texts, repeated rows, columns whose names clash with results."""
    long = " ".join(random.Random(5).choice(["alpha", "beta", "gamma", "delta"]) + str(i % 997) for i in range(40_000))
    rows = [(1, "hello world this is a small text", "en", "s", 1, 0.5, "x", "y", 1), (1, "hello world this is a small text", "en", "s", 1, 0.5, "x", "y", 1), (2, None, None, None, None, None, None, None, None), (3, "", "en", "s", 0, 0.1, "", "", 0), (None, "no key at all in this one here", "de", None, 3, 0.1, None, None, None), (4, long, "en", "s", 9, 0.1, "", "", 0), (5, "12 %% !!", "en", "s", 9, 0.1, "", "", 0)]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql_twins(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df, r = queries.QUERIES[name](spark, SF), con.sql(queries.SQL[name])
    cols = r.columns
    order = sorted(cols)
    assert sorted(df.columns) == order
    cell = lambda v: "~" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)
    assert sorted(tuple(cell(x[c]) for c in order) for x in df.collect()) == sorted(tuple(cell(x[cols.index(c)]) for c in order) for x in r.fetchall())


# ---- 1 and 7: links against brute force --------------------------------------------------------------------------


def components_of(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_embeddings_equal_brute_force(spark):
    r = np.random.default_rng(1)
    base = r.standard_normal((30, 16))
    vectors = np.concatenate([base, base[:10] + 0.05 * r.standard_normal((10, 16)), base[:5] * 3, base[:1].repeat(40, 0) + 0.02 * r.standard_normal((40, 16)), base[:1].repeat(5, 0)]).astype(np.float32)
    rows = [(i, [float(x) for x in v], int(i % 2)) for i, v in enumerate(vectors)]
    rows += [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, [1.0, None], 0), (904, rows[0][1], None), (905, rows[0][1][:8], 0), (None, rows[0][1], 1), (906, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("id", F.lit(1)).withColumn("c1", F.lit("x"))
    got = {x.vec_id: x for x in op01_embedding_dedup.near_duplicates(df, op01_embedding_dedup.Params(block=16)).collect() if x.vec_id is not None}
    good = [(i, np.asarray(v, np.float64), lab) for i, v, lab in rows if lab is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = set()
    for i, a, p in good:
        for j, b, q in good:
            if i is not None and p == q and len(a) == len(b) and i != j and j is not None and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.93:
                links.add((i, j))
    null_links = collections.Counter(i for i, a, p in good for j, b, q in good if j is None and i is not None and p == q and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.93)
    comp = components_of([x for x in got], links)
    for i, x in got.items():
        assert (x.n_links, x.component_id, x.kept) == (sum(a == i for a, _ in links) + null_links[i], comp[i], comp[i] == i)


def test_embeddings_of_rows_that_repeat_a_key(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (3, [0.01, 1.0], 0), (3, [0.01, 1.0], 0), (4, [1.0, -1.0], 0)]
    got = op01_embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((x.vec_id, x.n_links, x.component_id) for x in got) == [(1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1), (3, 2, 1), (4, 0, 4)]


def test_embeddings_of_an_empty_table(spark):
    assert op01_embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def jaccard_links(docs, p):
    sets = dict(zip([k for k, _ in docs], op07_ngram_join.ngram_hashes([t for _, t in docs], p.n), strict=True))
    links = set()
    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and len(a) and len(b):
                both = len(np.intersect1d(a, b))
                if both >= p.threshold * (len(a) + len(b) - both) - 1e-9:
                    links.add((i, j))
    return links


def test_ngram_join_equals_brute_force(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    texts = []
    for _ in range(25):
        words = [word() for _ in range(r.randrange(3, 120))]
        texts.append(" ".join(words))
        for _ in range(r.randrange(0, 6)):
            w = list(words)
            for _ in range(r.randrange(0, 3)):
                w[r.randrange(len(w))] = word()
            texts.append(" ".join(w))
    docs = [*enumerate(texts), (1000, None), (1001, ""), (1002, "?!"), (1003, "two words"), (1004, "Two, words")]
    p = op07_ngram_join.Params(block=8)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("id", F.lit("x")).withColumn("key", F.lit(1))
    got = {x.doc_id: x for x in op07_ngram_join.near_duplicates(df, p).collect()}
    links = jaccard_links(docs, p)
    comp = components_of([k for k, _ in docs], links)
    assert len(got) == len(docs)
    for k, _ in docs:
        assert (got[k].n_links, got[k].class_id) == (sum(k in x for x in links), comp[k])


def test_ngram_join_of_hostile_rows(spark):
    got = op07_ngram_join.near_duplicates(hostile(spark)).collect()
    assert len(got) == 7 and [x.n_links for x in got if x.doc_id == 1] == [1, 1]
    assert op07_ngram_join.near_duplicates(empty(spark)).count() == 0


def test_ngram_join_keeps_links_of_rows_that_share_a_key(spark):
    r = random.Random(8)
    text = lambda: [r.choice(string.ascii_lowercase) + str(r.randrange(10**6)) for _ in range(60)]
    near = lambda w: " ".join([*w[:-1], "other"])
    rows = []
    for i in range(12):  # A and B are different texts of equal length under one key; each has a near copy
        a, b = text(), text()
        rows += [(3 * i, " ".join(a)), (3 * i, " ".join(b)), (3 * i + 1, near(a)), (3 * i + 2, near(b))]
    got = op07_ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 48 and {x.n_links for x in got} == {1}
    assert all(x.class_id == x.doc_id - x.doc_id % 3 for x in got)


def test_ngram_join_gives_each_row_once_whatever_its_letters(spark):
    odd = [chr(c) for c in (0x870, 0x88F, 0x1C89, 0xA7CB, 0x10D40, 0x16D40, 0xBD, 0x2160)]
    rows = [(i, f"{c}{c} {c}") for i, c in enumerate(odd)] + [(100, "?!"), (101, None), (102, "")]
    got = op07_ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(x.doc_id for x in got) == sorted(k for k, _ in rows) and {x.n_links for x in got} == {0}


def test_ngram_join_query_equals_brute_force(spark):
    docs = [tuple(x) for x in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    links = jaccard_links(docs, op07_ngram_join.Params())
    comp, count = components_of([k for k, _ in docs], links), collections.Counter(k for x in links for k in x)
    got = {x.doc_id: (x.n_links, x.class_id) for x in queries.op7_ngram_join(spark, SF).collect()}
    assert got == {k: (count[k], comp[k]) for k, _ in docs}


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7)]
    got = {x.node: x.component for x in blocks.components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 60)}}


# ---- 2 and 4: held-out accuracy ----------------------------------------------------------------------------------


def test_toxicity_holds_out(spark):
    sf = "/root/testdata/sf0.1"
    df = queries.op2_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    pos, neg = df[df.toxic == 1], df[df.toxic == 0]
    assert (neg.predicted == 0).mean() > 0.995 and (pos.predicted == 1).mean() > 0.7
    assert np.mean(pos.score.to_numpy()[:, None] > neg.score.to_numpy()[None, :]) > 0.97


def test_toxicity_hostile(spark):
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    model = op02_toxicity.fit(hostile(spark), labels)
    got = op02_toxicity.score(hostile(spark), model)
    assert got.count() == 7 and got.where("score is null or score < 0 or score > 1").count() == 0
    none = op02_toxicity.fit(hostile(spark), labels.limit(0))
    assert {x.score for x in op02_toxicity.score(hostile(spark), none).collect()} == {0.0}
    assert op02_toxicity.score(empty(spark), model).count() == 0


def slow_ftrl(texts, labels, order, p):
    """The method once more, feature by feature."""
    rows = []
    for t in texts:
        w = [xxh(x) for x in re.findall(r"[^\W_]+", t.lower())]
        a, b, c, full = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 2**64
        f = {h * a % full >> 64 - p.bits for h in w}
        for gap, salt in ((1, b), (2, c)):
            f |= {((x * b % full) ^ ((y * salt + a) % full)) * a % full >> 64 - p.bits for x, y in zip(w, w[gap:])}
        rows.append(f)
    count = collections.Counter(x for f in rows for x in f)
    kept = [{x for x in f if count[x] >= min(p.min_rows, len(rows))} for f in rows]
    z, n = collections.defaultdict(float), collections.defaultdict(float)
    weight = lambda x: 0.0 if x is not None and abs(z[x]) <= p.l1 else -(z[x] - (0 if x is None else math.copysign(p.l1, z[x]))) / ((p.beta + math.sqrt(n[x])) / p.alpha)
    for _ in range(p.epochs):
        for i in order:
            w = {x: weight(x) for x in [None, *kept[i]]}
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w.values()))))) - labels[i]
            for x in w:
                z[x] += g - (math.sqrt(n[x] + g * g) - math.sqrt(n[x])) / p.alpha * w[x]
                n[x] += g * g
    return lambda f: 1 / (1 + math.exp(-(weight(None) + sum(weight(x) for x in f)))), rows


def test_toxicity_equals_the_method_feature_by_feature(spark):
    rng = random.Random(9)
    bad, fine = ["awful", "nasty", "vile"], ["kind", "calm", "warm", "clear", "green"]
    labels = [i % 3 == 0 for i in range(90)]
    texts = [" ".join(rng.choice(bad if y and rng.random() < 0.6 else fine) for _ in range(rng.randrange(0, 14))) for y in labels]
    df = spark.createDataFrame([(i, t, int(y)) for i, (t, y) in enumerate(zip(texts, labels, strict=True))], "doc_id long, text string, toxic int")
    p = op02_toxicity.Params(l1=0.5)
    model = op02_toxicity.fit(df, df, p)
    order = sorted(range(90), key=lambda i: xxh(str(i)))
    score, rows = slow_ftrl(texts, labels, order, p)
    got = {x.doc_id: x.score for x in op02_toxicity.score(df, model).collect()}
    assert all(abs(got[i] - score(rows[i])) < 1e-5 for i in got) and len(set(got.values())) > 20


def test_toxicity_does_not_look_at_held_out_labels(spark, tmp_path):
    for name, flip in (("a", "toxic"), ("b", "1 - toxic")):
        held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
        spark.read.parquet(f"{SF}/labels.parquet").withColumn("toxic", F.when(held, F.expr(flip)).otherwise(F.col("toxic"))).write.parquet(f"{tmp_path}/{name}/labels.parquet")
        spark.read.parquet(f"{SF}/documents.parquet").withColumn("lang", F.lit(name)).withColumn("source", F.lit(name)).write.parquet(f"{tmp_path}/{name}/documents.parquet")
    a, b = (sorted(map(tuple, queries.op2_toxicity(spark, f"{tmp_path}/{x}").collect())) for x in "ab")
    assert a == b


def test_toxicity_bounds_the_features_it_learns_from(spark):
    df = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(50)), i % 2) for i in range(40)], "doc_id long, text string, toxic int")
    model = op02_toxicity.fit(df, df, op02_toxicity.Params(max_slots=1500))
    assert op02_toxicity.score(df, model).where("score between 0 and 1").count() == 40


def test_language_holds_out(spark):
    df = queries.op4_language(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (df.lang == df.lang_pred).mean() > 0.97 and df.rejected.mean() < 0.03


def test_language_hostile(spark):
    learnt = op04_language.fit(hostile(spark))
    got = {x.doc_id: x for x in op04_language.predict(hostile(spark), learnt).collect()}
    assert (got[2].lang_pred, got[3].lang_pred, got[5].lang_pred) == ("und", "und", "und") and got[1].lang_pred in ("en", "de")
    assert op04_language.predict(empty(spark), {}).count() == 0
    assert {x.lang_pred for x in op04_language.predict(hostile(spark), op04_language.fit(empty(spark))).collect()} == {"und"}


def test_language_learns_from_null_and_hot_keys(spark):
    word = lambda rng, letters: "".join(rng.choice(letters) for _ in range(6))
    rng = random.Random(3)
    texts = lambda letters, n: [f"{word(rng, letters)} {word(rng, letters)}" for _ in range(n)]
    rows = [(None, t, "aa") for t in texts("abcdef", 300)] + [(k, t, "aa") for k, t in enumerate(texts("abcdef", 20))]
    rows += [(7, t, "bb") for t in texts("uvwxyz", 400)]  # one key carries all rows of its language
    rows += [(k, "mmm nnn", "cc") for k in range(300)] + [(1000, "ooo ppp", "cc")]
    learnt = op04_language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {k: len(set(v.decode().split("\n"))) for k, v in learnt.items()} == {"aa": 256, "bb": 256, "cc": 2}


def test_language_equals_compressing_by_hand(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    p = op04_language.Params(block_chars=300)
    learnt = op04_language.fit(docs, p)
    got = {x.doc_id: x for x in op04_language.predict(docs, learnt, p).collect()}
    for x in docs.collect():
        clean = re.sub(r"[\W\d_]+", " ", (x.text or "").lower()).strip()
        sizes = []
        for name, raw in learnt.items():
            how = zstandard.ZstdCompressionParameters.from_level(p.level, source_size=p.block_chars, dict_size=len(raw), min_match=p.min_match, write_content_size=False, write_checksum=False, write_dict_id=False)
            own = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how)
            sizes.append((sum(len(own.compress(clean[i : i + 300].encode())) for i in range(0, len(clean), 300)), name))
        assert got[x.doc_id].lang_pred == (min(sizes, key=lambda s: s[0])[1] if clean else "und")


def test_language_without_letters_is_undetermined(spark):
    learnt = {"en": b"some english words", "de": b"ein paar deutsche worte"}
    rows = [(1, "\u00bd \u00b2 \u2460 \u2167"), (2, "1 2 _ %"), (3, "some words"), (4, None), (5, "\u00bd words")]
    got = {x.doc_id: x.lang_pred for x in op04_language.predict(spark.createDataFrame(rows, "doc_id long, text string"), learnt).collect()}
    assert (got[1], got[2], got[4]) == ("und", "und", "und") and got[3] == got[5] == "en"


def test_language_ties_go_to_the_larger_then_the_first(spark):
    rows = [("b", "mmm nnn ooo")] * 2 + [("a", "mmm nnn ooo")] * 2 + [("c", "mmm nnn ooo")] * 3
    docs = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "doc_id long, lang string, text string")
    for some, want in ((docs, "c"), (docs.where("lang <> 'c'"), "a")):
        got = op04_language.predict(docs, op04_language.fit(some)).collect()
        assert {(x.lang_pred, x.rejected) for x in got} == {(want, True)}


def test_language_learns_any_number_of_languages_from_whole_texts(spark):
    rows = [(i, f"l{i:03d}", f"word{i}x " * 3) for i in range(230)]
    rows += [(1000, "tail", "x" * 5000 + " " + "rare closing words of the text")]
    learnt = op04_language.fit(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    assert len(learnt) == 231 and b"rare closing words of the text" in learnt["tail"]


def test_language_does_not_look_at_held_out_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    docs.withColumn("lang", F.when(held, F.lit("zz")).otherwise(F.col("lang"))).write.parquet(f"{tmp_path}/documents.parquet")
    rows = lambda sf: sorted(map(tuple, queries.op4_language(spark, sf).collect()))
    assert rows(SF) == rows(str(tmp_path))


# ---- 3: rollups --------------------------------------------------------------------------------------------------


def test_rollup_is_idempotent_and_compacts(spark):
    roll = op03_token_counts.TokenRollup(spark, work_dir(spark, "roll"))
    rows = spark.createDataFrame([("a", "en", 5), ("a", None, None), (None, "en", 7), ("a", "en", 1)], "source string, lang string, n long")
    put = op03_token_counts.changes(rows, 1, "t", "n")
    assert roll.totals().count() == 0
    assert roll.apply("b1", put) and not roll.apply("b1", put)
    want = {("a", "en", "t", 2, 6), ("a", None, "t", 1, 0), (None, "en", "t", 1, 7)}
    assert {tuple(x) for x in roll.totals().collect()} == want
    roll.apply("none", put.limit(0))
    small = roll.compact(work_dir(spark, "roll"))
    assert {tuple(x) for x in small.totals().collect()} == want and not small.apply("b1", put)
    small.apply("b2", op03_token_counts.changes(rows.where("source = 'a'"), -1, "t", "n"))
    assert {tuple(x) for x in small.totals().collect()} == {(None, "en", "t", 1, 7)}


def test_compaction_loses_no_batch(spark):
    row = lambda n: op03_token_counts.changes(spark.createDataFrame([("s", "en", n)], "source string, lang string, n long"), 1, "t", "n")
    roll = op03_token_counts.TokenRollup(spark, work_dir(spark, "roll"))
    roll.apply("b1", row(5))
    small = roll.compact(work_dir(spark, "roll"))
    assert small.apply("compacted", row(7)) and not small.apply("b1", row(5))
    roll.apply("late", row(1))  # to the old one, after it was compacted: not done in the new one
    assert small.apply("late", row(1)) and [x.n_tokens for x in small.totals().collect()] == [13]
    again = small.compact(work_dir(spark, "roll"))
    assert [x.n_tokens for x in again.totals().collect()] == [13] and not again.apply("compacted", row(7))


def test_rollup_of_hostile_rows(spark):
    roll = op03_token_counts.TokenRollup(spark, work_dir(spark, "roll"))
    docs = hostile(spark).withColumn("sign", F.lit("x")).withColumn("tokens", F.lit("y")).withColumn("batch", F.lit(1))
    docs = docs.withColumn("n", op03_token_counts.count_tokens("text", op03_token_counts.TOKENIZERS["white-1"]))
    roll.apply("b", op03_token_counts.changes(docs, 1, "white-1", "n"))
    assert {(x.source, x.lang): (x.n_docs, x.n_tokens) for x in roll.totals().collect()} == {("s", "en"): (5, 14 + 0 + 40_000 + 3), (None, None): (1, 0), (None, "de"): (1, 8)}


# ---- 5: URL rules ------------------------------------------------------------------------------------------------


def slow_judge(url, rules):
    host, path = op05_url_filter.split_url(url)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best.verdict if best else "allow"


def test_url_rules_equal_brute_force(spark, monkeypatch):
    r = random.Random(4)
    hosts = ["example.org", "a.example.org", "org", "xexample.org", "com", "b.com", "", "EXAMPLE.ORG"]
    urls = [None, "", "no scheme", "http://", "://org", "http://org?x/es/", "x://y://org/es/"] + [f"http{r.choice(['', 's'])}://{r.choice(hosts)}{r.choice(['', '/', '/es/', '/en/1', '/en/12#/es/', '/de/x?/fr/', '/fr/'])}" for _ in range(200)]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in op05_url_filter.judge(df, queries.URL_RULES).collect()}
    assert got == {i: slow_judge(u, queries.URL_RULES) for i, u in enumerate(urls)}
    rules = spark.createDataFrame([(x.host, x.path, x.verdict) for x in queries.URL_RULES], "host string, path string, verdict string")
    joined = op05_url_filter.judge(df, rules, max_bytes=0)
    assert joined.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    assert {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in joined.collect()} == got
    assert {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in op05_url_filter.judge(df, rules).collect()} == got
    # equal rules, and verdicts with one initial: both ways give the same
    Rule = op05_url_filter.Rule
    twice = [Rule("block", "org", "/"), Rule("allow", "org", "/"), Rule("audit", "com", "/"), Rule("banned", "b.com", "/")]
    rows = lambda x: sorted(map(tuple, x.select("page_id", "rule", "verdict").collect()))
    ours = rows(op05_url_filter.judge(df, twice))
    assert ours == rows(op05_url_filter.judge(df, twice, max_bytes=0)) and {v for _, r, v in ours if r} == {"allow", "audit", "banned"}
    assert {x.verdict for x in op05_url_filter.judge(df, []).collect()} == {"allow"}
    assert op05_url_filter.judge(df.limit(0), queries.URL_RULES).count() == 0


def test_url_digest_collisions_are_confirmed(tmp_path, monkeypatch):
    monkeypatch.setattr(op05_url_filter.xxhash, "xxh64_intdigest", lambda s: 7)
    (tmp_path / "f").write_bytes(op05_url_filter.DigestFile.pack(queries.URL_RULES))
    got = op05_url_filter.DigestFile(str(tmp_path / "f")).judge([("example.org", "/es/1"), ("net", "/es/")])
    assert got == [("example.org/es/", "block"), None]


# ---- 6: archives -------------------------------------------------------------------------------------------------


def test_warc_hostile(spark):
    big, small = "x" * 200, "y" * 20
    rows = [(3, "u", big), (1, "u\r\nv", big), (2, None, small), (4, "u", small), (5, "u", None), (1, "u", big), (6, "u", "é" * 60), (7, "u", "é" * 60), (None, "u", big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("d", F.lit(1))
    got = sorted((x.page_id or 0, x.record_type, x.refers_to, x.payload_bytes) for x in op06_warc_zip.warc_round_trip(df).collect())
    assert got == [(0, "revisit", 1, 200), (1, "response", None, 200), (1, "response", None, 200), (2, "response", None, 20), (3, "revisit", 1, 200), (4, "response", None, 20), (5, "response", None, 0), (6, "response", None, 120), (7, "revisit", 6, 120)]
    assert op06_warc_zip.warc_round_trip(df.limit(0)).count() == 0


class Bytes(io.BytesIO):
    def size(self):
        return len(self.getvalue())

    def read_at(self, n, at):
        self.seek(at)
        return self.read(n)


def test_zip64_directories():
    raw = Bytes()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as z:
        with z.open(zipfile.ZipInfo("big"), "w", force_zip64=True) as f:
            f.write(b"0123456789")
        z.writestr("packed", b"a" * 100, zipfile.ZIP_DEFLATED)
        for i in range(66_000):  # more entries than the plain end record can count
            z.writestr(zipfile.ZipInfo(f"e{i}"), b"")
        z.comment = b"PK comment"
    package = op06_warc_zip.RangeZip(raw)
    assert len(package.members) == 66_002 and package.read("big", 3, 4) == b"3456" and package.read("big", 8, 99) == b"89"
    with pytest.raises(ValueError):
        package.read("packed")


def test_zip_comments_prefixes_and_damage():
    def package(comment=b"", prefix=b"", big=False):
        raw = Bytes()
        with zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as z:
            for i in range(66_000 if big else 1):
                z.writestr(zipfile.ZipInfo(f"e{i}"), b"payload")
            z.comment = comment
        return Bytes(prefix + raw.getvalue())

    end = b"PK\x05\x06" + bytes(18)
    for comment in (b"", b"x" * 10 + end, end, end + b"tail", b"PK\x05\x06"):
        for prefix in (b"", b"#!/bin/sh\n" * 9):
            found = op06_warc_zip.RangeZip(package(comment, prefix))
            assert list(found.members) == ["e0"] and found.read("e0") == b"payload"
    found = op06_warc_zip.RangeZip(package(prefix=b"before", big=True))
    assert len(found.members) == 66_000 and found.read("e65999", 3) == b"load"
    whole = package().getvalue()
    for bad in (whole[:-1], b"", b"no archive", whole[:-22] + whole[-22:].replace(b"\x01\x00\x01\x00", b"\x00\x00\x00\x00", 1)):
        with pytest.raises(ValueError):
            op06_warc_zip.RangeZip(Bytes(bad))


def test_warc_packages_roll_over_and_hold_long_texts(spark):
    rows = [(i, "u", f"page {i} " * 40) for i in range(60)] + [(60, "u", "long " * 400_000), (61, "u", "long " * 400_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    manifest = op06_warc_zip.write(df, work_dir(spark, "warc"), max_package_bytes=1500)
    assert manifest.count() > 10
    got = {x.page_id: x for x in op06_warc_zip.read_back(manifest).collect()}
    assert {k: (got[k].payload_bytes, got[k].payload_digest) for k in got} == {k: (len(t), hashlib.sha256(t.encode()).hexdigest()) for k, _, t in rows}
    assert (got[60].record_type, got[61].record_type, got[61].refers_to) == ("response", "revisit", 60)


# ---- 8 and 10: tokens --------------------------------------------------------------------------------------------


def nasty_texts():
    r = random.Random(1)
    letters = "abc éÉßΣςσİIıŸ12٣Ⅷ½'sT're<|endoftext|>\x1c\x1f\x85\u2003\u3000漢字🙂\u0327\u0301e\n\t_-..!!ǅﬁſ"
    more = ["the", "ing", "<|endoftext|>", "<|ENDOFTEXT|>", "aaaa", "'ll", "zzzz"]
    out = ["".join(r.choice([r.choice(letters), r.choice(more)]) for _ in range(r.randrange(0, 30))) for _ in range(1500)]
    return out + ["".join(r.choice(string.ascii_lowercase[:6]) for _ in range(50_000)), "", " \n "]


def test_bpe_is_exact():
    library, (bpe, known) = Tokenizer.from_file(VOCAB), op10_bpe.encoder(VOCAB)
    texts = nasty_texts()
    ids, ends = known.encode_all([bpe.pieces(t) for t in texts])
    fast = op08_token_files.library_encoder(VOCAB)
    ids8, ends8 = fast(texts)
    for i, t in enumerate(texts):
        want = library.encode(t, add_special_tokens=False).ids
        assert ids[ends[i] : ends[i + 1]].tolist() == want == ids8[ends8[i] : ends8[i + 1]].tolist()
        op10 = op10_bpe.encoder(VOCAB)[0].names_of(np.array(want, np.int64)).decode()
        assert op10 == library.decode(want, skip_special_tokens=False)


def test_bpe_is_exact_on_every_code_point():
    library, (bpe, known) = Tokenizer.from_file(VOCAB), op10_bpe.encoder(VOCAB)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    texts = [" ".join(f"a{c}b {c}!1{c}" for c in points[i : i + 32]) for i in range(0, len(points), 32)]
    ids, ends = known.encode_all([bpe.pieces(t) for t in texts])
    want = [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    assert np.array_equal(ids, np.concatenate(want)) and np.array_equal(np.diff(ends), [len(w) for w in want])
    fast = op08_token_files.library_encoder(VOCAB)
    texts = ["a{}b".format(c) for c in points[0x80:0x3000] + points[0xA000 : 0xAC00] + points[0x10000:0x1F000:7]]
    assert np.array_equal(fast(texts)[0], np.concatenate([e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]))


def test_bpe_is_exact_where_marks_combine():
    library, (bpe, known) = Tokenizer.from_file(VOCAB), op10_bpe.encoder(VOCAB)
    fast, r = op08_token_files.library_encoder(VOCAB), random.Random(6)
    marks = [chr(c) for c in range(0x300, 0x110000) if not 0xD800 <= c <= 0xDFFF and (unicodedata.combining(chr(c)) or unicodedata.decomposition(chr(c))[:1] not in ("", "<"))]
    texts = ["".join(r.choice([r.choice(marks), r.choice(marks), "a", "E", chr(r.randrange(0x11000, 0x11A00)), " "]) for _ in range(8)) for _ in range(20_000)]
    want = np.concatenate([e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)])
    assert np.array_equal(known.encode_all([bpe.pieces(t) for t in texts])[0], want) and np.array_equal(fast(texts)[0], want)


def test_tables_that_fill_up_stay_exact():
    library, words = Tokenizer.from_file(VOCAB), op08_token_files.LibraryWords(VOCAB, max_pieces=5, joined=3)
    bpe = op10_bpe.BacktrackingBpe(VOCAB)
    known = op10_bpe.PieceTable(bpe.encode_piece, max_pieces=5)
    for i in range(30):
        pieces = [f"word{j}s" for j in range(i, i + 9)] + ["don't", "a.b"]
        want = [e.ids for e in library.encode_batch(pieces, add_special_tokens=False)]
        assert words.encode_all([pieces])[0].tolist() == [x for w in want for x in w]
        assert known.encode_all([pieces])[0].tolist() == [x for w in want for x in w]


def test_bpe_query_on_hostile_rows(spark):
    library = Tokenizer.from_file(VOCAB)
    rows = op10_bpe.round_trip_digests(hostile(spark).select("doc_id", "text", "n_chars"), VOCAB).collect()
    assert len(rows) == 7
    texts = dict(hostile(spark).where("doc_id is not null").select("doc_id", "text").collect())
    for x in rows:
        if x.doc_id is not None:
            want = library.encode(texts[x.doc_id] or "", add_special_tokens=False).ids
            assert (x.n_tokens, x.ids_sha256) == (len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest())
            assert x.decoded_sha256 == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()
    there = op10_bpe.decode(op10_bpe.encode(hostile(spark), VOCAB), VOCAB)
    assert there.count() == 7 and op10_bpe.encode(empty(spark), VOCAB).count() == 0


def test_token_files(spark):
    docs = hostile(spark)
    manifest = op08_token_files.write(docs, work_dir(spark, "tokens"), VOCAB, queries.VOCAB_SIZE, queries.END_ID)
    library = Tokenizer.from_file(VOCAB)
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    got = sorted(op08_token_files.read_back(manifest).collect(), key=lambda x: x.start)
    at = 0
    for (k, t), x in zip(rows, got, strict=True):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        assert (x.doc_id, x.start, x.n_tokens, x.ids_crc32) == (k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    found = {x.doc_id: list(x.ids) for x in op08_token_files.lookup(spark.createDataFrame([(3,), (1,), (77,), (None,)], "doc_id long"), manifest).collect()}
    assert set(found) == {1, 3} and found[3] == [1]
    assert op08_token_files.token_files(spark, empty(spark), VOCAB, queries.VOCAB_SIZE, 1).count() == 0


def test_token_file_lookups(spark):
    r = random.Random(3)
    keys = [*r.sample(range(10**6), 400), 5_000_000, 5_000_000, 5_000_000]
    rows = [(k, " ".join(r.choice(["the", "old", "canal", "bridge"]) for _ in range(r.randrange(0, 9)))) for k in keys]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    manifest = op08_token_files.write(docs, work_dir(spark, "tokens"), VOCAB, queries.VOCAB_SIZE, queries.END_ID, max_file_bytes=60)
    assert manifest.count() > 4 and manifest.agg(F.sum("n_docs")).first()[0] == len(rows)
    library = Tokenizer.from_file(VOCAB)
    texts = {k: min(t for j, t in rows if j == k) for k in keys}
    want = {k: [*library.encode(t, add_special_tokens=False).ids, 1] for k, t in texts.items()}
    asked = spark.createDataFrame([(k,) for k in [*keys, *range(10**6, 10**6 + 300), None, -5]], "doc_id long")
    assert {x.doc_id: list(x.ids) for x in op08_token_files.lookup(asked, manifest).collect()} == want
    first = manifest.orderBy("base").first()
    with op08_token_files.ShardReader(first.path) as one:
        assert one.get(first.first_key).tolist() == want[first.first_key] and one.get(10**9) is None
    assert op08_token_files.lookup(asked, manifest.limit(0)).count() == 0
    back = sorted((x.start, x.doc_id, x.n_tokens) for x in op08_token_files.read_back(manifest).collect())
    assert [k for _, k, _ in back] == sorted(keys) and all(a + n == b for (a, _, n), (b, _, _) in zip(back, back[1:]))


def test_strange_keys_with_equal_fingerprints_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(op08_token_files, "fingerprints", lambda keys: np.zeros(len(keys), "<u4"))
    uri = work_dir(spark, "one") + "/f.tok"
    out = op08_token_files.ShardWriter(uri, 2)
    out.add(np.arange(0, 200, 2), np.arange(100), np.ones(100, np.int64))
    out.close()
    with op08_token_files.ShardReader(uri) as f:
        assert [f.get(k) is None for k in range(201)] == [k % 2 == 1 or k == 200 for k in range(201)]


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(0).integers(-(2**62), 2**62, 20_000)).view(np.uint64)
    table = op08_token_files.PerfectHash.build(keys)
    assert np.array_equal(np.sort(table.slots(keys)), np.arange(len(keys)))
    assert op08_token_files.PerfectHash.build(keys[:0]).slots(keys[:3]).tolist() == [-1, -1, -1]


# ---- 9: decontamination ------------------------------------------------------------------------------------------


def test_reparameterised_questions(spark):
    item = "A train leaves Springfield station at 12 km per hour and carries 40 boxes each of which weighs 3 kg for the long trip"
    docs = [
        (1, "Some words first. " + item + " and some words after."),
        (2, item.replace("12", "15.5").replace("40", "41").replace("3 kg", "9 kg").replace("Springfield", "Shelbyville")),
        (3, item.lower().replace("boxes", "apples").replace("train", "bus").replace("hour", "day").replace("trip", "road").replace("carries", "takes")),
        (4, "nothing of the kind is in this text at all, it only has words that are common"), (5, None), (6, ""), (None, item), (7, "12 13 14 15 16 17 18 19 20 21 22 23 24"),
    ]
    bench = spark.createDataFrame([(0, item), (1, None), (2, "1 2 3 4 5 6 7 8 9 10 11 12"), (3, "too short"), (0, item)], "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("h", F.lit(1)).withColumn("item", F.lit(1)).withColumn("k", F.lit(1))
    assert sorted((x.doc_id, x.item_id) for x in op09_decontaminate.contaminated(df, bench).collect()) == [(1, 0), (2, 0)]
    # values that stand for each other inconsistently are no copy of the question
    twice = "the first tank holds 5 litres of oil and the second tank also holds 5 litres of oil when both tanks are full"
    b = spark.createDataFrame([(0, twice)], "item_id long, text string")
    d = spark.createDataFrame([(1, twice.replace("5", "8")), (2, twice.replace("5", "8", 1))], "doc_id long, text string")
    assert [x.doc_id for x in op09_decontaminate.contaminated(d, b, op09_decontaminate.Params(window=14)).collect()] == [1]
    assert op09_decontaminate.contaminated(df.limit(0), bench).count() == 0 and op09_decontaminate.contaminated(df, bench.limit(0)).count() == 0


def test_decontamination_finds_verbatim_items(spark):
    twice = "the first tank holds 5 litres of oil and the second tank also holds 5 litres of oil when both tanks are full at the end of each working shift"
    values = "a shop that sells 12 green apples and 10 red apples to the people of the town has no more of them at the end"
    bench = spark.createDataFrame([(0, "Name seven noble gases"), (1, "12 + 30 = 42, 7 + 8 = 15, 6 + 5 = 11, 90"), (2, twice), (3, values), (4, ""), (5, "?!")], "item_id long, text string")
    docs = [
        (1, "Now answer: Name seven noble gases. Then rest."), (2, "name seven gases that are noble"), (3, "Sums: 12 + 30 = 42, 7 + 8 = 15, 6 + 5 = 11, 90 and so on"), (4, "Sums: 13 + 30 = 43, 7 + 9 = 16, 6 + 6 = 12, 91"),
        (5, twice.replace("5", "8", 1)), (6, values.replace("12", "10")), (7, twice.replace("5", "8")), (8, ""), (9, None),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for p in (op09_decontaminate.Params(verbatim=True), op09_decontaminate.Params(verbatim=True, max_broadcast=0)):
        got = op09_decontaminate.contaminated(df, bench, p).collect()
        assert sorted((x.doc_id, x.item_id) for x in got) == [(1, 0), (3, 1), (5, 2), (6, 3), (7, 2)]


def test_decontamination_of_very_long_texts(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 60").orderBy("item_id").first()
    filler = " ".join(f"filler{i} text{i % 7}" for i in range(60_000))
    docs = spark.createDataFrame([(1, f"{filler} {item.text} {filler}"), (2, filler)], "doc_id long, text string")
    got = op09_decontaminate.contaminated(docs, spark.read.parquet(f"{SF}/benchmark.parquet"), op09_decontaminate.Params(verbatim=True)).collect()
    assert {x.doc_id for x in got} == {1} and item.item_id in {x.item_id for x in got}


def test_decontamination_shuffles_where_it_cannot_broadcast(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    rows = lambda p: sorted(map(tuple, op09_decontaminate.contaminated(docs, bench, p).collect()))
    assert rows(op09_decontaminate.Params()) == rows(op09_decontaminate.Params(max_broadcast=0))


# ---- pipeline ----------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if i < 4:
            assert out.columns == docs.columns, name
            kept, keys = {x.doc_id for x in out.select("doc_id").collect()}, {x.doc_id for x in docs.select("doc_id").collect()}
            assert kept <= keys and len(kept) >= 0.5 * len(keys)
            if name == "n-gram Jaccard join":
                pairs = [tuple(x) for x in docs.select("doc_id", "text").collect()]
                comp = components_of([k for k, _ in pairs], jaccard_links(pairs, op07_ngram_join.Params()))
                assert kept == {k for k, c in comp.items() if k == c}
            docs = spark.createDataFrame(out.toPandas(), out.schema)
    library = Tokenizer.from_file(VOCAB)
    texts = dict(docs.select("doc_id", "text").collect())
    for x in out.limit(20).collect():
        assert list(x.ids) == library.encode(texts[x.doc_id], add_special_tokens=False).ids
    assert out.count() == docs.count() < n


def test_pipeline_judges_each_row_by_its_own_text(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 60").orderBy("item_id").first().text
    copied = "seven grey herons stood beside the old canal while nobody on the bridge cared to look at them"
    other = "the committee will meet on the second floor after lunch to talk about the new bicycle stands"
    third = "rain fell on the tin roof all night and the children counted drops until they were asleep"
    cols = "doc_id long, text string, lang string, source string, n_chars long"
    rows = lambda *pairs: spark.createDataFrame([(k, t, "en", "s", 1) for k, t in pairs], cols)
    left = lambda df: sorted(((x.doc_id, x.text) for x in df.collect()), key=str)
    got = left(corpus_pipeline.near_duplicates(spark, rows((None, copied), (None, copied), (3, copied), (3, copied), (4, copied), (4, other), (None, third), (None, third), (5, None), (5, "")), SF))
    assert got == sorted([(3, copied), (4, other), (None, third), (5, None), (5, "")], key=str)
    got = left(corpus_pipeline.decontamination(spark, rows((None, item), (6, item), (6, other), (None, third)), SF))
    assert got == sorted([(6, other), (None, third)], key=str)


def test_pipeline_on_hostile_and_empty_tables(spark, tmp_path):
    docs = hostile(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for name, frame in (("hostile", docs), ("empty", docs.limit(0))):
        frame.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, 0), (4, None), (None, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        spark.createDataFrame([(0, "an item of a benchmark"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    left = corpus_pipeline.run(spark, f"{tmp_path}/hostile").collect()
    assert sorted((x.doc_id for x in left), key=str) == [1, 4, None] or {x.doc_id for x in left} <= {1, 4, None}
    assert len([x for x in left if x.doc_id == 1]) <= 1
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0


def test_pipeline_keeps_unique_rows_that_share_a_key(spark):
    t, u = "one two three four five six seven eight", "quite another text that no other row has in it"
    rows = spark.createDataFrame([(1, t, "en", "s", 1), (1, t, "en", "s", 1), (5, t, "en", "s", 1), (5, u, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((x.doc_id, x.text) for x in corpus_pipeline.near_duplicates(spark, rows, SF).collect()) == [(1, t), (5, u)]
