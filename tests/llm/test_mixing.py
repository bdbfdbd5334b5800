import pytest
from pyspark.sql import functions as F
from sieveworks.llm import mixing as X


@pytest.mark.parametrize("mean, cap", [(0.3, 1), (0.3, 4), (1.0, 2), (2.5, 3), (2.999, 3), (7.0, 20)])
def test_steps_have_the_mean(mean, cap):
    s = X.steps(mean, cap)
    assert len(s) == cap and s == sorted(s)
    assert abs(sum(1 - x for x in s) - mean) < 1e-6


def test_extreme_steps():
    assert X.steps(3.0, 3) == [0.0] * 3 and X.steps(0.0, 2) == [1.0] * 2 and X.steps(1.0, 0) == []


def sizes(spark):
    n = {"big": 20000, "small": 3000, "tiny": 50, "untold": 500}
    parts = [spark.range(n[s]).select((F.col("id") + 100_000 * i).alias("record_id"), F.lit(s).alias("source"), (F.col("id") % 50).alias("n_tokens")) for i, s in enumerate(n)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.unionByName(spark.createDataFrame([(999_999, None, 5)], "record_id long, source string, n_tokens long"))


def test_shares_are_met_within_caps(spark):
    t = spark.createDataFrame([("big", 0.5, 1), ("small", 0.48, 3), ("absent", 0.02, 5)], "source string, target_share double, max_repeats int")
    s = sizes(spark)
    plan = X.plan(s, t, exact_shares=True)
    got = {r["source"]: r for r in X.shares(X.repeats(s, plan), plan).collect()}
    assert abs(got["big"]["actual_share"] - 0.5 / 0.98) < 0.01 and abs(got["small"]["actual_share"] - 0.48 / 0.98) < 0.01
    assert got["absent"]["mixed_tokens"] == 0 and got["small"]["most_copies"] <= 3 and got["big"]["most_copies"] <= 1 and "untold" not in got
    mix = X.mixture(X.repeats(s, plan))
    assert mix.groupBy("record_id").agg(F.max("copy").alias("m")).agg(F.max("m")).first()[0] <= 3
    assert [r["shuffle_key"] for r in mix.limit(50).collect()] == sorted(r["shuffle_key"] for r in mix.limit(50).collect())


def test_small_source_falls_short_and_spread_is_stated(spark):
    t = spark.createDataFrame([("big", 0.6, 1), ("small", 0.35, 3), ("tiny", 0.05, 2)], "source string, target_share double, max_repeats int")
    s = sizes(spark)
    got = {}
    for seed in range(12):
        plan = X.plan(s, t)
        for r in X.shares(X.repeats(s, plan, seed), plan).collect():
            got.setdefault(r["source"], []).append(r)
    total = 20000 * 24.5 + 3000 * 24.5 + 50 * 24.5
    assert all(r["most_copies"] == 2 and r["rate"] == 2.0 for r in got["tiny"])  # used up to its cap
    assert all(abs(r["rate"] - 0.6 * total / (20000 * 24.5)) < 1e-3 for r in got["big"])
    for source, rows in got.items():
        mean = sum(r["actual_share"] for r in rows) / len(rows)
        sd = (sum((r["actual_share"] - mean) ** 2 for r in rows) / (len(rows) - 1)) ** 0.5
        assert sd < 2 * rows[0]["share_sd"] + 1e-9 and rows[0]["share_sd"] < 0.01, source


def test_empty(spark):
    s = sizes(spark).limit(0)
    t = spark.createDataFrame([("big", 0.5, 1)], "source string, target_share double, max_repeats int")
    plan = X.plan(s, t)
    assert X.mixture(X.repeats(s, plan)).count() == 0 and X.shares(X.repeats(s, plan), plan).first()["actual_share"] == 0.0
    none = X.plan(sizes(spark), t.limit(0))
    assert none.count() == 0
