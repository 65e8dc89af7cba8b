"""The self-join of a hot key is dealt over tasks and still gives every pair once."""

from pyspark.sql import functions as F

from helixframe.operators import patterns


def test_a_hot_key_lies_in_many_parts(spark, monkeypatch):
    monkeypatch.setattr(patterns, "_MANY", 40, raising=False)
    rows = [("hot" if i < 300 else f"k{i % 9}" if i < 340 else None, f"s{i}", "abc"[i % 3]) for i in range(360)]
    df = spark.createDataFrame(rows, "k string, stmt string, strength string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = patterns.theta_self_join(df, ["k"], ["stmt", "strength"]).withColumn("at", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    want = sorted((a[0], a[1], b[1]) for a in rows for b in rows if a[0] is not None and a[0] == b[0] and a[1] != b[1] and a[2] != b[2])
    assert sorted((r["k"], r["stmt"], r["stmt_2"]) for r in got) == want
    assert len({r["at"] for r in got if r["k"] == "hot"}) > 1
