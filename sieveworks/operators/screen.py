"""Screening of items against rules: joins that carry a status.

Nulls never match a key. Rules are pre-aggregated where a join needs one row a
key. All joins are equi-joins on the rule key, but for ``every_spec``; the
planner broadcasts a side only under its own size check.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spread import spread_join

EPSILON = 1e-12


def meets(value: Column, limit: Column, operator: Column) -> Column:
    """value >= limit or > limit by the operator column, with a dead band; null for other operators."""
    return F.when(operator == ">=", value >= limit - EPSILON).when(operator == ">", value > limit + EPSILON)


def meets_or_fails(value: Column, limit: Column, operator: Column) -> Column:
    """``meets``, but an error for an operator that is none of the known."""
    return F.when(operator.isin(">=", ">"), meets(value, limit, operator)).otherwise(F.raise_error(F.concat(F.lit("unknown operator "), F.coalesce(operator, F.lit("null")))))


def trigger_categories(value: Column, limits: Mapping[str, Column]) -> Column:
    """Names of the limits that the value reaches, in order; missing ones don't count."""
    return F.array_join(F.array_compact(F.array(*[F.when(value >= c, F.lit(k)) for k, c in limits.items()])), ";")


def direction(old: Column, new: Column) -> Column:
    """How a limit moved: a lower one is stricter; a missing side needs review."""
    return F.when(old.isNull() | new.isNull(), "review").when(F.abs(old - new) <= EPSILON, "maintained").when(new < old, "strengthened").otherwise("relaxed")


def status(value: Column, limit: Column, excluded: Column) -> Column:
    """Excluded, unknown value, unknown limit, triggered or below, in that order."""
    return (
        F.when(F.coalesce(excluded, F.lit(False)), "EXCLUDED")
        .when(value.isNull(), "VALUE_MISSING")
        .when(limit.isNull(), "LIMIT_MISSING")
        .when(value >= limit, "TRIGGERED")
        .otherwise("BELOW")
    )


def with_no_match(hits: DataFrame, items: DataFrame, item_id: str, sentinel: Mapping[str, Column]) -> DataFrame:
    """hits, and one sentinel row for each item without any."""
    rest = items.join(hits.select(item_id).distinct(), item_id, "left_anti").select(item_id, *[v.alias(k) for k, v in sentinel.items()])
    return hits.select(item_id, *sentinel).unionByName(rest)


def bridged(items: DataFrame, bridge: DataFrame, summary: DataFrame, item_key: str, target: str, valid: Column) -> DataFrame:
    """items joined with the summary of each target that a valid row of the bridge (item_key, target, ..) leads to, each pair once."""
    pairs = bridge.filter(F.coalesce(valid, F.lit(False))).select(item_key, target).dropna().distinct()
    return items.join(pairs, item_key).join(summary, target)


def looked_up(df: DataFrame, pairs: DataFrame, key: str, value: str, default: str) -> DataFrame:
    """df with the value of its key in pairs, made unique first, or the default."""
    one = pairs.dropna(subset=[key]).groupBy(key).agg(F.min(value).alias(value))
    return df.join(one, key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def checked_join(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """A join to at most one row a key; a key that the right side has twice is an error where it is met."""
    rest = [c for c in right.columns if c != key]
    one = right.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*rest)).alias("_s"))
    safe = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit(f"{key} isn't unique: "), F.col(key).cast("string")))).otherwise(F.col("_s"))
    return left.join(one.select(key, safe.alias("_s")), key, how).select(*left.columns, *[F.col(f"_s.{c}").alias(c) for c in rest])


def fallback_join(left: DataFrame, right: DataFrame, first: str, second: str, values: Sequence[str]) -> DataFrame:
    """left joined with right on ``first``; rows without a partner on ``second`` instead."""
    one = right.filter(F.col(first).isNotNull()).select(first, *values)
    two = right.filter(F.col(first).isNull()).select(second, *values)
    hit = left.join(one, first)
    rest = left.join(one.select(first).distinct(), first, "left_anti").join(two, second)
    return hit.withColumn("matched_by", F.lit(first)).unionByName(rest.withColumn("matched_by", F.lit(second)))


def member_sets(df: DataFrame, owner: str, member: str) -> DataFrame:
    """(owner, members): the sorted distinct members of each owner."""
    return df.filter(F.col(member).isNotNull()).groupBy(owner).agg(F.array_sort(F.collect_set(F.col(member).cast("string"))).alias("members"))


def set_classes(a: DataFrame, b: DataFrame, owner_a: str, owner_b: str, member: str) -> DataFrame:
    """(side, owner, set_id, n_a, n_b): owners of either side whose set of members also occurs on the other, by class.

    A set that very many owners share gives as many rows as owners, not pairs.
    """
    x = member_sets(a, owner_a, member).select(F.lit("a").alias("side"), F.col(owner_a).alias("owner"), "members")
    y = member_sets(b, owner_b, member).select(F.lit("b").alias("side"), F.col(owner_b).alias("owner"), "members")
    every = x.unionByName(y).select("side", "owner", F.sha2(F.to_json("members"), 256).alias("set_id"))
    sizes = every.groupBy("set_id").agg(F.count_if(F.col("side") == "a").alias("n_a"), F.count_if(F.col("side") == "b").alias("n_b"), F.count(F.lit(1)).alias("n")).filter("n_a > 0 and n_b > 0")
    return spread_join(every, sizes, ["set_id"], "owner").select("side", "owner", "set_id", "n_a", "n_b")


def same_sets(a: DataFrame, b: DataFrame, owner_a: str, owner_b: str, member: str) -> DataFrame:
    """Owners whose sets of members are equal, as pairs; ``set_classes`` where sets are common."""
    met = member_sets(a, owner_a, member).join(member_sets(b, owner_b, member), "members")
    return met.select(owner_a, owner_b, F.array_join("members", "|").alias("signature"))


def unique_target(memberships: DataFrame, item: str, target: str) -> DataFrame:
    """(item, n_targets, outcome): found with exactly one target, review with more."""
    per = memberships.groupBy(item).agg(F.count_distinct(target).alias("n_targets"), F.min(target).alias("_only"))
    return per.select(item, "n_targets", F.when(F.col("n_targets") == 1, F.concat(F.lit("FOUND:"), F.col("_only").cast("string"))).otherwise("REVIEW").alias("outcome"))


def overlap_join(rules: DataFrame, rule_id: str, members: str, items: DataFrame, item_id: str, key: str) -> DataFrame:
    """(rule, item, n_common): rules whose list of keys meets the item's keys."""
    one = rules.select(rule_id, F.explode(F.array_distinct(members)).alias("_k"))
    return one.join(items.select(item_id, F.col(key).alias("_k")).distinct(), "_k").groupBy(rule_id, item_id).agg(F.count(F.lit(1)).alias("n_common"))


def by_mode(items: DataFrame, specs: DataFrame, key: str, tests: Mapping[str, Column], otherwise: str) -> DataFrame:
    """Items met by specs of their class, each tested by the predicate of the spec's mode; unknown modes ask for review.

    Specs come by an equi-join on ``key``, so the pairs are those a class has.
    """
    outcome = reduce(lambda w, kv: w.when(F.col("mode") == kv[0], F.when(kv[1], "MATCH").otherwise("NO_MATCH")), tests.items(), F.when(F.lit(False), ""))
    return items.join(specs, key).withColumn("outcome", outcome.otherwise(otherwise))


def every_spec(items: DataFrame, specs: DataFrame, by: Sequence[str], tests: Mapping[str, tuple[str, Column]], otherwise: str) -> DataFrame:
    """(by.., mode, outcome, n): each spec against every item; mode -> (column tested, predicate), unknown modes ask for review of all.

    Each mode's specs meet the distinct values of the column it tests, with
    their numbers of items, in a nested loop; the items themselves aren't paired.
    """
    n = F.count(F.lit(1)).alias("_n")
    hits = [
        specs.filter(F.col("mode") == mode).crossJoin(items.groupBy(value).agg(n)).select(*by, "mode", F.when(test, "MATCH").otherwise("NO_MATCH").alias("outcome"), "_n")
        for mode, (value, test) in tests.items()
    ]
    known = F.coalesce(F.col("mode").isin(list(tests)), F.lit(False))
    hits.append(specs.filter(~known).crossJoin(items.agg(n).filter("_n > 0")).select(*by, "mode", F.lit(otherwise).alias("outcome"), "_n"))
    return reduce(DataFrame.unionByName, hits).groupBy(*by, "mode", "outcome").agg(F.sum("_n").alias("n"))
