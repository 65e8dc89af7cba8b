"""Bounds that hold on repeated and many keys, keys at the ends of their range, short benchmark items, the pipeline stage by stage."""

import collections

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from helixframe.llm import op02_toxicity, op04_language, op08_token_files, op09_decontaminate, op10_bpe, queries
from helixframe.llm.common import learn_bucket, work_dir

SF = "/root/testdata/sf0.001"


# ---- 2: one key that many rows bear ------------------------------------------------------------------------------


def learnt(monkeypatch, docs, labels, params):
    """The rows that reach the learning task."""
    seen = []
    real = op02_toxicity.stored
    monkeypatch.setattr(op02_toxicity, "stored", lambda df, what: seen.append(real(df, what)) or seen[-1])
    model = op02_toxicity.fit(docs, labels, params)
    return seen[0], model


def test_the_row_bound_holds_for_repeated_ids(spark, monkeypatch):
    same = [(1, "the very same text of one id") for _ in range(4000)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(31)], "doc_id long, toxic int")
    few = spark.createDataFrame(same + [(i, f"text number {i}") for i in range(2, 31)], "doc_id long, text string")
    rows, _ = learnt(monkeypatch, few, labels, op02_toxicity.Params(max_rows=50))
    assert rows.count() == 30  # repeated rows are one, and nothing had to go
    many = spark.createDataFrame([(1, f"another text {i} of one id") for i in range(4000)] + [(i, f"text number {i}") for i in range(2, 31)], "doc_id long, text string")
    rows, model = learnt(monkeypatch, many, labels, op02_toxicity.Params(max_rows=50))
    assert 0 < rows.count() <= 100
    again = op02_toxicity.fit(many.repartition(7), labels, op02_toxicity.Params(max_rows=50))
    assert again.intercept == model.intercept and np.array_equal(again.weights, model.weights)  # arrival doesn't matter


# ---- 4: many languages -------------------------------------------------------------------------------------------


def test_dictionaries_of_many_languages_are_bounded_together(spark):
    p = op04_language.Params(max_bytes=4 * 768 * 2000)
    docs = spark.range(4000).select(F.concat(F.lit("l"), (F.col("id") % 1000).cast("string")).alias("lang"), F.concat(F.lit("word"), F.col("id").cast("string"), F.lit(" "), F.repeat(F.concat(F.lit("x"), (F.col("id") % 1000).cast("string"), F.lit(" ")), 200)).alias("text"))
    found = op04_language.fit(docs, p)
    assert len(found) == 1000 and sum(map(len, found.values())) <= p.max_bytes
    with pytest.raises(ValueError, match="1000 languages"):
        op04_language.fit(docs, op04_language.Params(max_bytes=4 * 768 * 999))


# ---- 8: keys at the ends, hot keys -------------------------------------------------------------------------------


def test_keys_at_the_ends_and_hot_keys_come_back(spark):
    low, high = -(2**63), 2**63 - 1
    rows = [(low, "first of all"), (low, "first again"), (high, "last"), (None, "no key"), (None, "no key two"), (None, None), (0, "zero"), (0, "")] + [(7, f"hot {i}") for i in range(200)] + [(None, f"cold {i}") for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    manifest = op08_token_files.write(docs, work_dir(spark, "ends"), queries.VOCABULARY, queries.VOCAB_SIZE, 1).cache()
    back = op08_token_files.read_back(manifest).collect()
    assert collections.Counter(r.doc_id for r in back) == collections.Counter(k for k, _ in rows)
    library = Tokenizer.from_file(queries.VOCABULARY)
    n_ids = lambda t: len(library.encode(t or "", add_special_tokens=False).ids) + 1
    told = sorted(back, key=lambda r: r.start)
    assert [r.doc_id for r in told] == sorted((k for k, _ in rows), key=lambda k: (k is not None, k or 0))
    assert all(a.start + a.n_tokens == b.start for a, b in zip(told, told[1:], strict=False))
    assert collections.Counter((r.doc_id, r.n_tokens) for r in back) == collections.Counter((k, n_ids(t)) for k, t in rows)
    assert manifest.where("n_docs >= 100").count() < 2 or manifest.count() >= 3  # the hot keys lie in several files
    asked = spark.createDataFrame([(low,), (high,), (7,), (0,), (None,), (5,)], "doc_id long")
    got = {r.doc_id: list(r.ids) for r in op08_token_files.lookup(asked, manifest).collect()}
    texts = collections.defaultdict(list)
    for k, t in rows:
        texts[k].append([*library.encode(t or "", add_special_tokens=False).ids, 1])
    assert set(got) == {low, high, 7, 0} and all(ids in texts[k] for k, ids in got.items())


def test_token_files_equal_the_library_over_a_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    library, end = Tokenizer.from_file(queries.VOCABULARY), np.array([1], "<u4")
    import zlib

    at, want = 0, {}
    for k, t in sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()):
        ids = np.append(np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4"), end)
        want[k], at = (at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), at + len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.QUERIES["op8_token_files"](spark, SF).collect()} == want


# ---- 9: short items, SQL of all its ways -------------------------------------------------------------------------


def test_short_items_say_nothing_and_are_listed(spark):
    bench = spark.createDataFrame([(1, "Yes"), (2, "What is the capital of France"), (3, ""), (4, "true or false"), (5, None)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"Well yes, this is text number {i} and it is true or false.") for i in range(20)] + [(20, "Tell me: what is the capital of France? Yes.")], "doc_id long, text string")
    got = op09_decontaminate.contaminated(docs, bench, op09_decontaminate.Params(verbatim=True)).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(20, 2)]
    assert {(r.item_id, r.n_words) for r in op09_decontaminate.unsought(bench).collect()} == {(1, 1), (3, 0), (4, 3), (5, 0)}


def test_sql_gives_short_slot_heavy_and_altered_items(spark):
    twice = "the first tank holds 5 litres of oil and the second tank also holds 5 litres of oil when both tanks are full at the end of each working shift"
    sums = "12 + 30 = 42, 7 + 8 = 15, 6 + 5 = 11, 90"
    short = "What is the capital of France"
    bench = spark.createDataFrame([(1, "Yes"), (2, short), (3, sums), (4, twice), (4, twice), (None, twice), (5, "Name seven noble gases"), (6, None)], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, f"Now: {short}? Rest."), (2, f"Sums: {sums} and so on"), (3, sums.replace("12", "13")), (4, twice.replace("5", "8", 1)), (5, twice.replace("5", "8")), (6, twice), (7, "name seven gases that are noble"), (8, "Name seven noble gases."), (9, None), (10, ""), (None, twice), (6, short)],
        "doc_id long, text string",
    )
    con = duckdb.connect()
    for name, t in (("documents", docs), ("benchmark", bench)):
        arrow = pa.table(t.toArrow())
        con.register(name, arrow)
    for p in (op09_decontaminate.Params(verbatim=True), op09_decontaminate.Params()):
        want = sorted((k, i, n, m, round(c, 9)) for k, i, n, m, c in con.sql(op09_decontaminate.oracle(p)).fetchall())
        got = sorted((r[0], r[1], r[2], r[3], round(r[4], 9)) for r in op09_decontaminate.contaminated(docs, bench, p).collect())
        assert got == want and len(got) >= 6


# ---- pipeline ----------------------------------------------------------------------------------------------------


def test_each_stage_against_its_operator_row_by_row(spark):
    """What a stage keeps is what its model says of each row alone, worked out without Spark's columns."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({"_row_number": F.lit("own"), "_toxic": F.lit(9), "Score": F.lit("s")})
    texts = {r.doc_id: r.text for r in docs.collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic").where(learn_bucket("doc_id", 5) != 0)
    model = op02_toxicity.fit(docs, labels)
    dense = np.zeros(1 << model.bits, np.float32)
    dense[model.slots] = model.weights
    keys = sorted(texts)
    bad = {k for k, s in zip(keys, op02_toxicity.score_texts(model, [texts[k] for k in keys], dense), strict=True) if s >= 0.5}
    out = corpus_pipeline.toxicity(spark, docs, SF)
    assert out.columns == docs.columns and out.where("_row_number <> 'own' or _toxic <> 9 or Score <> 's'").count() == 0
    assert {r.doc_id for r in out.collect()} == set(keys) - bad
    dictionaries = op04_language.fit(docs.where(learn_bucket("doc_id", 3) != 1))
    judge = op04_language.Classifier(dictionaries)
    out = corpus_pipeline.language(spark, docs, SF)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == {k for k in keys if judge.judge(texts[k])[2] >= judge.p.min_margin}
    held = {r.doc_id for r in op09_decontaminate.contaminated(docs, spark.read.parquet(f"{SF}/benchmark.parquet"), op09_decontaminate.Params(verbatim=True)).collect()}
    out = corpus_pipeline.decontamination(spark, docs, SF)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == set(keys) - held and out.where("_row_number <> 'own'").count() == 0
    library = Tokenizer.from_file(queries.VOCABULARY)
    assert {r.doc_id: list(r.ids) for r in corpus_pipeline.encoding(spark, docs, SF).collect()} == {k: library.encode(t or "", add_special_tokens=False).ids for k, t in texts.items()}


def test_round_trip_digests_equal_the_library_over_a_whole_table(spark):
    import hashlib

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    library, want = Tokenizer.from_file(queries.VOCABULARY), {}
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    got = op10_bpe.round_trip_digests(docs.select("doc_id", "text"), queries.VOCABULARY)
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect()} == want


def test_stages_keep_very_long_texts_and_clashing_columns(spark):
    long = " ".join(f"word{i} of the river" for i in range(40_000))
    docs = spark.createDataFrame([(1, long, "en", "s", 1, 5, "x"), (2, long + " and one more", "en", "s", 1, 6, "y"), (3, None, None, None, None, 7, None)], "doc_id long, text string, lang string, source string, n_chars long, _row_number long, class_id string")
    out = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert out.columns == docs.columns and sorted((r.doc_id, r._row_number, r.class_id) for r in out.collect()) == [(1, 5, "x"), (3, 7, None)]
    assert corpus_pipeline.decontamination(spark, docs, SF).count() == 3


def test_pipeline_numbers_rows_by_file_and_place(spark, tmp_path):
    """Every row has a number of its own that stays however the files are cut; what isn't a plain scan is written instead."""
    path = f"{tmp_path}/a b%20c"
    rows = [(i % 7 if i % 5 else None, f"text {i % 11}", "net") for i in range(900)]
    spark.createDataFrame(rows, "doc_id long, text string, _metadata string").repartition(6).write.parquet(path)
    docs = spark.read.parquet(path)
    assert corpus_pipeline.file_scan(docs)
    assert not corpus_pipeline.file_scan(docs.where("doc_id > 1")) and not corpus_pipeline.file_scan(spark.range(3))
    seen = []
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for most in (before, "1k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        try:
            numbered, row = corpus_pipeline.numbered(docs, "rows")
            seen.append(sorted((r[row], str(r.doc_id), r.text) for r in numbered.collect()))
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        assert numbered.columns == [*docs.columns, row]
    assert seen[0] == seen[1] and len({x[0] for x in seen[0]}) == len(rows)
    for other in (docs.where("doc_id > 1"), docs.unionAll(docs)):
        numbered, row = corpus_pipeline.numbered(other, "rows")
        assert numbered.select(row).distinct().count() == other.count()
