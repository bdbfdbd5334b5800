"""Repeated answers reduced to one: votes, ranks, agreement, completeness."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def majority(df: DataFrame, by: Sequence[str], vote: Column, valid: Sequence[str], abstain: str = "REVIEW", repeats: int | None = None) -> DataFrame:
    """(by.., decision, n_votes): the vote that more than half of all cast, else abstention.

    Invalid votes count as abstentions. With ``repeats``, groups of another
    number of votes abstain.
    """
    cast = F.when(vote.isin(*valid), vote).otherwise(abstain)
    per = df.groupBy(*by, cast.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    sums = per.groupBy(*by).agg(F.sum("_n").alias("n_votes"), F.max(F.struct("_n", "_v")).alias("_top"))
    won = F.col("_top._n") * 2 > F.col("n_votes")
    if repeats is not None:
        won &= F.col("n_votes") == repeats
    return sums.select(*by, F.when(won, F.col("_top._v")).otherwise(abstain).alias("decision"), "n_votes")


def in_every(df: DataFrame, item: str, stratum: str) -> DataFrame:
    """Items that occur in every stratum (division)."""
    pairs = df.select(item, stratum).dropna().distinct()
    need = pairs.agg(F.count_distinct(stratum).alias("_need"))
    return pairs.groupBy(item).agg(F.count(F.lit(1)).alias("n_strata")).crossJoin(need).filter("n_strata = _need").drop("_need")


def consistency(df: DataFrame, by: str, item: str, answer: str, repeats: int) -> DataFrame:
    """(by, n_complete, n_agree, agreement): items with all repeats, and those whose repeats agree."""
    per = df.groupBy(by, item).agg(F.count(answer).alias("_n"), F.count_distinct(answer).alias("_d")).filter(F.col("_n") == repeats)
    return per.groupBy(by).agg(F.count(F.lit(1)).alias("n_complete"), F.count_if(F.col("_d") == 1).alias("n_agree")).withColumn("agreement", F.round(F.col("n_agree") / F.col("n_complete"), 6))


def worst(df: DataFrame, by: str, rank: Column, what: str) -> DataFrame:
    """(by, worst, kinds): the highest ranked member controls; its kinds sorted."""
    top = F.max_by(what, F.struct(rank, F.col(what)))
    return df.groupBy(by).agg(top.alias("worst"), F.array_join(F.array_sort(F.collect_set(what)), ";").alias("kinds"))


def composition(members: DataFrame, owner: str, kind: str, amount: str, required: Sequence[str], any_of: Sequence[str], least_kinds: int, least_sum: float) -> DataFrame:
    """(owner, has_all, has_any, n_kinds, total, decision) of the members of each owner; a total of none is null."""
    flags: Mapping[str, Column] = {f"_r{i}": F.max((F.col(kind) == k).cast("int")) for i, k in enumerate(required)}
    per = members.groupBy(owner).agg(
        *[c.alias(k) for k, c in flags.items()],
        F.max(F.col(kind).isin(*any_of).cast("int")).alias("_any"),
        F.count_distinct(kind).alias("n_kinds"),
        F.round(F.sum(amount), 4).alias("total"),
    )
    has_all = sum((F.col(k) for k in flags), F.lit(0)) == len(flags)
    out = per.select(owner, has_all.alias("has_all"), (F.col("_any") == 1).alias("has_any"), "n_kinds", "total")
    good = F.col("has_all") & F.col("has_any") & (F.col("n_kinds") >= least_kinds)
    return out.withColumn("decision", F.when(~good, "NO_MATCH").when(F.col("total").isNull(), "REVIEW").when(F.col("total") >= least_sum, "MATCH").otherwise("NO_MATCH"))
