from pyspark.sql import functions as F
from sieveworks.operators import governance as G
from sieveworks.operators import windows
from sieveworks.streaming import screening as live


def test_overrides(spark):
    df = spark.createDataFrame([("1", "a"), ("2", "a"), ("3", "a"), ("4", None), ("5", "a"), (None, "a")], "k string, v string")
    o = spark.createDataFrame([("1", "a", "b", "seen"), ("2", "a", "b", " "), ("3", "x", "b", "seen"), ("4", None, "c", "seen"), ("5", "a", "b", "p"), ("5", "a", "c", "q")], "k string, from_value string, to_value string, evidence string")
    got = {r["k"]: (r["v"], r["override"]) for r in G.apply_overrides(df, o, "k", "v").collect()}
    assert got == {"1": ("b", "APPLIED"), "2": ("a", "NO_EVIDENCE"), "3": ("a", "FROM_DIFFERS"), "4": ("c", "APPLIED"), "5": ("a", "AMBIGUOUS"), None: ("a", "NONE")}


def test_carried_status(spark):
    now = spark.createDataFrame([("1", "x", None), ("2", "y", None), ("3", "z", "w")], "k string, a string, b string")
    old = spark.createDataFrame([("1", "x", None, "OK"), ("2", "q", None, "OK"), ("3", "z", None, "OK")], "k string, a string, b string, st string")
    assert {r["k"]: r["st"] for r in G.carry_status(now, old, "k", ["a", "b"], "st").collect()} == {"1": "OK", "2": "PENDING", "3": "PENDING"}


def test_quota_and_places(spark):
    df = spark.range(500).select(F.when(F.col("id") < 400, "hot").otherwise("cold").alias("s"), F.col("id").cast("string").alias("i"), "id")
    picked = G.quota_sample(df, ["s"], "i", "seed", 7).collect()
    assert sorted({(r["s"], r["i"]) for r in picked}) == sorted((r["s"], r["i"]) for r in picked) and len(picked) == 14
    placed = windows.place(df, "s", ["id"]).collect()
    assert all(r["place"] == (r["id"] + 1 if r["s"] == "hot" else r["id"] - 399) for r in placed)


def test_digest_and_keys(spark):
    df = spark.createDataFrame([("1", None), ("2", "b")], "k string, v string")
    assert G.frozen(df, "t", ["k", "v"]).first() == G.frozen(df.orderBy(F.desc("k")), "t", ["k", "v"]).first()
    assert G.same_keys(df, df.unionByName(df), "k").first()["equal"] and not G.same_keys(df, df.limit(1), "k").first()["equal"]


def test_stream_into_files(spark, tmp_path):
    schema = "id long, at timestamp, kind string, value double"
    for n, rows in enumerate(([(1, "a", 5.0), (1, "a", 5.0), (2, "b", None)], [(1, "a", 5.0), (3, "z", 9.0)])):
        spark.createDataFrame(rows, "id long, kind string, value double").selectExpr("id", "timestamp'2027-01-01 00:00:00' as at", "kind", "value").write.mode("append").parquet(str(tmp_path / "in"))
    stream = live.once(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "id", "at", "1 day")
    rules = spark.createDataFrame([("a", 4.0), ("b", 1.0)], "kind string, low double")
    hits = live.screened(stream, rules, "kind", F.col("value") >= F.col("low"))
    got = {(r["id"], r["triggered"]) for r in live.drain(hits.select("id", "triggered"), str(tmp_path / "out")).collect()}
    assert got == {(1, True), (2, False), (3, False)}
