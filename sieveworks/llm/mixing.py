"""Sources mixed to target shares of the total size, by Poisson replication.

Every document of a source is repeated a number of times that is drawn from a
Poisson distribution, by inverting it at a number hashed from the document's
id. The distribution is cut at the source's cap and its rate raised so that the
mean after the cut is the rate the target asks for. The total is the size asked
for, by default that of all documents of the wanted sources; a source that would
need more than its cap is used up to it and falls short, as its actual share
tells. With ``exact_shares`` the total is lowered instead until every source
that has documents reaches its share. Shares of sources without documents are
divided among the others in proportion; sources without a target get nothing.

Null and empty texts have size 0 and are left out. Empty tables give an empty
mixture.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 2**53: hashed numbers have as many steps.
_STEPS = float(1 << 53)


def _pmf(rate: float, cap: int) -> list[float]:
    out = [math.exp(-rate)]
    for k in range(1, cap + 1):
        out.append(out[-1] * rate / k)
    return out


def _mean(rate: float, cap: int) -> float:
    """Mean of the smaller of a Poisson count and the cap."""
    p = _pmf(rate, cap)
    return sum(k * x for k, x in enumerate(p[:cap])) + cap * max(0.0, 1 - sum(p[:cap]))


def steps(mean: float, cap: int) -> list[float]:
    """P(count <= k) for k below cap, of the distribution with this mean after the cut."""
    if cap <= 0 or mean <= 0:
        return [1.0] * max(cap, 0)
    if mean >= cap:
        return [0.0] * cap
    lo, hi = 0.0, 1.0
    while _mean(hi, cap) < mean and hi < 700:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _mean(mid, cap) < mean else (lo, mid)
    out, total = [], 0.0
    for x in _pmf(hi, cap)[:cap]:
        total += x
        out.append(min(1.0, total))
    return out


def plan(sizes: DataFrame, targets: DataFrame, total: int | None = None, exact_shares: bool = False) -> DataFrame:
    """One row per source of either side: (source, target_share, max_repeats, n_docs, n_tokens, rate, steps).

    sizes: (source, n_tokens) rows; there are as few sums as sources.
    """
    have = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    want = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    spark = sizes.sparkSession
    kinds = "source string, target_share double, max_repeats int, n_docs long, n_tokens long, rate double, steps array<double>"
    # only the targets' sources come to the driver
    rows = want.join(have, "source", "left").collect()
    live = [r for r in rows if r["source"] is not None and (r["target_share"] or 0) > 0 and (r["n_tokens"] or 0) > 0 and (r["max_repeats"] or 0) > 0]
    share = sum(r["target_share"] for r in live)
    size = float(total if total is not None else sum(r["n_tokens"] for r in live))
    if exact_shares:
        size = min(size, min((r["max_repeats"] * r["n_tokens"] * share / r["target_share"] for r in live), default=0.0))
    rate = {r["source"]: min(float(r["max_repeats"]), size * r["target_share"] / share / r["n_tokens"]) for r in live}
    made = [
        (r["source"], float(r["target_share"] or 0), int(r["max_repeats"] or 0), int(r["n_docs"] or 0), int(r["n_tokens"] or 0), rate.get(r["source"], 0.0), steps(rate.get(r["source"], 0.0), int(r["max_repeats"] or 0)))
        for r in rows
        if r["source"] is not None
    ]
    return spark.createDataFrame(made, kinds)


def repeats(sizes: DataFrame, planned: DataFrame, seed: int = 17) -> DataFrame:
    """(record_id, source, n_tokens, n_copies): sizes with the number of copies of each document."""
    u = F.shiftrightunsigned(F.xxhash64("record_id", F.lit(seed)), 11) / F.lit(_STEPS)
    drawn = F.size(F.filter("steps", lambda x: x <= F.col("_u")))
    chosen = F.broadcast(planned.select("source", "steps"))  # as many rows as targets
    return sizes.filter(F.col("n_tokens") > 0).withColumn("_u", u).join(chosen, "source").select("record_id", "source", "n_tokens", drawn.alias("n_copies"))


def mixture(counted: DataFrame, seed: int = 17) -> DataFrame:
    """(record_id, source, copy, shuffle_key): every copy of every document, in the order of a hashed key."""
    copies = counted.filter("n_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    return copies.select("record_id", "source", "copy", F.xxhash64("record_id", "copy", F.lit(seed + 1)).alias("shuffle_key")).orderBy("shuffle_key", "record_id", "copy")


def shares(counted: DataFrame, planned: DataFrame) -> DataFrame:
    """Per source: target and actual share of the mixture's tokens, and the standard deviation that Poisson counts give the latter."""
    got = counted.groupBy("source").agg(F.sum("n_copies").alias("n_mixed"), F.sum(F.col("n_copies") * F.col("n_tokens")).alias("mixed_tokens"), F.max("n_copies").alias("most_copies"), F.sum(F.col("n_tokens").cast("double") * F.col("n_tokens")).alias("_squares"))
    over = F.transform("steps", lambda x: 1 - x)
    mean = F.aggregate(over, F.lit(0.0), lambda a, x: a + x)
    square = F.aggregate(F.transform(over, lambda x, k: (2 * k + 1) * x), F.lit(0.0), lambda a, x: a + x)
    joined = planned.join(got, "source", "left").withColumn("_var", F.coalesce(F.greatest(F.lit(0.0), square - mean * mean) * F.col("_squares"), F.lit(0.0)))
    total = joined.agg(F.sum("mixed_tokens").alias("_all"), F.sum("_var").alias("_vars"))
    share = F.coalesce(F.try_divide(F.col("mixed_tokens").cast("double"), F.col("_all")), F.lit(0.0))
    spread = F.sqrt(F.pow(1 - share, F.lit(2.0)) * F.col("_var") + share * share * (F.col("_vars") - F.col("_var")))
    return joined.crossJoin(F.broadcast(total)).select(
        "source", "target_share", "max_repeats", "n_docs", "n_tokens", F.round("rate", 6).alias("rate"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_mixed", "most_copies", "mixed_tokens")],
        F.round(share, 6).alias("actual_share"), F.coalesce(F.round(F.try_divide(spread, F.col("_all")), 6), F.lit(0.0)).alias("share_sd"),
    )
