"""Snapshots compared: what was added, removed, changed, and which way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, signature: Column) -> DataFrame:
    """(key, change, n_old, n_new): the sets of row signatures of each key, before and after.

    One aggregation over both sides; each key's signatures are a set, so
    repeated rows make no difference.
    """
    tag = lambda df, side: df.filter(F.col(key).isNotNull()).select(key, signature.alias("_s"), F.lit(side).alias("_side"))
    per = tag(old, 1).unionByName(tag(new, 2)).distinct().groupBy(key, "_s").agg(F.sum("_side").alias("_in"))
    sums = per.groupBy(key).agg(F.count_if(F.col("_in") != 2).alias("n_old"), F.count_if(F.col("_in") != 1).alias("n_new"), F.count_if(F.col("_in") == 3).alias("_both"))
    change = F.when(F.col("n_old") == 0, "ADDED").when(F.col("n_new") == 0, "REMOVED").when((F.col("n_old") == F.col("_both")) & (F.col("n_new") == F.col("_both")), "UNCHANGED").otherwise("MODIFIED")
    return sums.select(key, change.alias("change"), "n_old", "n_new")


def overall_label(labels: Column) -> Column:
    """One label of a set of transitions, by precedence; sets of different moves are mixed, and so is the empty set."""
    only = lambda x: (F.size(labels) == 1) & F.array_contains(labels, x)
    two = lambda x, y: (F.size(labels) == 2) & F.array_contains(labels, x) & F.array_contains(labels, y)
    return (
        F.when(F.array_contains(labels, "review"), "review")
        .when(only("deleted"), "deleted")
        .when(only("maintained"), "maintained")
        .when(only("strengthened") | two("maintained", "strengthened"), "strengthened")
        .when(only("relaxed"), "relaxed")
        .otherwise("mixed")
    )


def pair_reconciliation(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """(a, side, n): pairs on the left only, the right only and on both sides, by a."""
    tag = lambda df, side: df.select(a, b).dropna().distinct().withColumn("_side", F.lit(side))
    per = tag(left, 1).unionByName(tag(right, 2)).groupBy(a, b).agg(F.sum("_side").alias("_in"))
    name = F.when(F.col("_in") == 1, "left_only").when(F.col("_in") == 2, "right_only").otherwise("both")
    return per.groupBy(a, name.alias("side")).agg(F.count(F.lit(1)).alias("n"))


def impact(old: DataFrame, new: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """(keys.., impact): whether anything triggered before and after."""
    tag = lambda df, side: df.groupBy(*keys).agg(F.max(F.col(flag).cast("int")).alias("_t")).withColumn("_side", F.lit(side))
    both = tag(old, "o").unionByName(tag(new, "n")).groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("_side") == "o", F.col("_t"))), F.lit(0)).alias("_o"), F.coalesce(F.max(F.when(F.col("_side") == "n", F.col("_t"))), F.lit(0)).alias("_n"))
    what = F.when((F.col("_o") == 0) & (F.col("_n") == 1), "NEWLY_TRIGGERED").when((F.col("_o") == 1) & (F.col("_n") == 0), "NO_LONGER").when(F.col("_o") == 1, "STILL").otherwise("NEVER")
    return both.select(*keys, what.alias("impact"))


def replace_version(table: DataFrame, candidate: DataFrame, version: str) -> DataFrame:
    """table with the candidate's versions put in place of its own."""
    return table.join(candidate.select(version).distinct(), version, "left_anti").unionByName(candidate)
