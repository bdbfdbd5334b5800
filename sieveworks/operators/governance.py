"""Corrections, carried decisions, quotas and frozen content.

Keys are single columns; null keys never match. Every function takes whole
tables; where a rule asks for exactly one target, others are reported with the
reason instead of being dropped.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def apply_overrides(df: DataFrame, overrides: DataFrame, key: str, column: str) -> DataFrame:
    """df with corrected values and an ``override`` status.

    overrides: (key, from_value, to_value, evidence). One applies if it is the
    only one of its key, its from_value is what stands there and it has
    evidence; else the status says why not and the value stays.
    """
    per = overrides.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min("from_value").alias("_from"), F.min("to_value").alias("_to"), F.min("evidence").alias("_why"))
    status = (
        F.when(F.col("_n").isNull(), "NONE")
        .when(F.col("_n") > 1, "AMBIGUOUS")
        .when(F.coalesce(F.trim("_why"), F.lit("")) == "", "NO_EVIDENCE")
        .when(~F.col(column).eqNullSafe(F.col("_from")), "FROM_DIFFERS")
        .otherwise("APPLIED")
    )
    out = df.join(per, key, "left").withColumn("override", status)
    return out.withColumn(column, F.when(F.col("override") == "APPLIED", F.col("_to")).otherwise(F.col(column))).drop("_n", "_from", "_to", "_why")


def carry_status(now: DataFrame, before: DataFrame, key: str, content: Sequence[str], status: str, otherwise: str = "PENDING") -> DataFrame:
    """(key, status): earlier decisions survive only where key and content are the same."""
    print_of = F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in content]), 256)
    old = before.select(key, print_of.alias("_p"), F.col(status).alias("_s")).groupBy(key, "_p").agg(F.min("_s").alias("_s"))
    return now.select(key, print_of.alias("_p")).distinct().join(old, [key, "_p"], "left").select(key, F.coalesce("_s", F.lit(otherwise)).alias(status))


def quota_sample(df: DataFrame, strata: Sequence[str], ident: str, seed: str, quota: int) -> DataFrame:
    """At most ``quota`` rows of each stratum, by a seeded hash of the id.

    The smallest hashes of a stratum are kept by a bounded aggregate, so a hot
    stratum isn't sorted in one task.
    """
    h = F.sha2(F.concat(F.lit(seed), F.col(ident).cast("string")), 256)
    first = df.select(*strata, ident, h.alias("_h")).withColumn("_part", F.pmod(F.xxhash64(ident), F.lit(64)))
    small = lambda x: F.slice(F.array_sort(F.collect_list(x)), 1, quota)
    cut_once = _smallest(first, [*strata, "_part"], ident, quota)
    per = cut_once.groupBy(*strata).agg(small(F.struct("_h", ident)).alias("_k"))
    return per.select(*strata, F.explode("_k").alias("_e")).select(*strata, F.col(f"_e.{ident}").alias(ident))


def _smallest(df: DataFrame, by: Sequence[str], ident: str, n: int) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy("_h", ident)  # a group limit runs before its shuffle
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def upgraded(base: Column, offer: Column, ranks: Mapping[str, int], keep: str) -> Column:
    """The better ranked of two routes; ``keep`` is never given up, unknown routes rank last."""
    from ..functions.conditions import route_rank

    a, b = route_rank(base, ranks, 99), route_rank(offer, ranks, 99)
    return F.when(base == keep, base).when(offer.isNotNull() & (b < a), offer).otherwise(base)


def frozen(df: DataFrame, name: str, columns: Sequence[str]) -> DataFrame:
    """(artifact, n_rows, digest): two 56-bit sums of row hashes, whatever the order of rows."""
    row = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns]), 256)
    part = lambda at: F.sum(F.conv(F.substring(row, at, 14), 16, 10).cast("decimal(38,0)")).cast("string")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.concat_ws(":", F.coalesce(part(1), F.lit("0")), F.coalesce(part(15), F.lit("0"))).alias("digest")).select(F.lit(name).alias("artifact"), "n_rows", "digest")


def same_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(n_a, n_b, n_both, equal) of the distinct keys of two tables."""
    tag = lambda df, v: df.select(key).dropna().distinct().withColumn("_s", F.lit(v))
    per = tag(a, 1).unionByName(tag(b, 2)).groupBy(key).agg(F.sum("_s").alias("_in"))
    out = per.agg(F.count_if(F.col("_in") != 2).alias("n_a"), F.count_if(F.col("_in") != 1).alias("n_b"), F.count_if(F.col("_in") == 3).alias("n_both"))
    return out.withColumn("equal", (F.col("n_a") == F.col("n_both")) & (F.col("n_b") == F.col("n_both")))


def verified(actual: DataFrame, manifest: DataFrame) -> DataFrame:
    """(artifact, state): each artifact of either side, SAME, CHANGED, MISSING or UNLISTED.

    Both sides are (artifact, n_rows, digest) as made by ``frozen``.
    """
    a, m = actual.select("artifact", F.struct("n_rows", "digest").alias("_a")), manifest.select("artifact", F.struct("n_rows", "digest").alias("_m"))
    state = F.when(F.col("_m").isNull(), "UNLISTED").when(F.col("_a").isNull(), "MISSING").when(F.col("_a") == F.col("_m"), "SAME").otherwise("CHANGED")
    return a.join(m, "artifact", "full").select("artifact", state.alias("state"))


def verify(actual: DataFrame, manifest: DataFrame) -> DataFrame:
    """actual itself, or an error naming the artifacts that aren't as frozen."""
    bad = [f"{r['artifact']}: {r['state']}" for r in verified(actual, manifest).filter("state <> 'SAME'").orderBy("artifact").limit(20).collect()]
    if bad:
        raise ValueError(f"not as frozen: {', '.join(bad)}")
    return actual


def challenge_sample(df: DataFrame, challenge: Column, stratum: str, ident: str, seed: str, n: int) -> DataFrame:
    """(ident, stratum, reason): n rows, challenges first.

    If there are no more than n rows all are taken. If there are at least n
    challenges, each stratum of them gives an equal quota and the rest is
    filled from all of them; else all challenges are taken and filled up from
    the others. Within each the smallest seeded hashes come first. A hash prefix
    found by counts bounds what is sorted to about n rows.
    """
    from .windows import smallest

    h = F.sha2(F.concat(F.lit(seed), F.col(ident).cast("string")), 256)
    rows = df.select(ident, stratum, F.coalesce(challenge, F.lit(False)).alias("_c"), h.alias("_x"))
    sizes = {r["_c"]: r["n"] for r in rows.groupBy("_c").agg(F.count(F.lit(1)).alias("n")).collect()}
    hard, total = sizes.get(True, 0), sum(sizes.values())
    out = lambda d, reason: d.select(ident, stratum, reason.alias("reason"))
    if total <= n:
        return out(rows, F.lit("ALL"))
    mine = rows.filter("_c")
    if n >= hard:
        return out(mine, F.lit("CHALLENGE")).unionByName(out(smallest(rows.filter("not _c"), "_x", ident, n - hard), F.lit("CONTROL")))
    strata = mine.select(stratum).distinct().count()
    quota = max(1, n // strata)
    from pyspark.sql import Window

    ranked = mine.withColumn("_r", F.row_number().over(Window.partitionBy(stratum).orderBy("_x", ident))).filter(F.col("_r") <= quota).drop("_r")
    first = smallest(ranked, "_x", ident, n)
    rest = smallest(mine.join(first.select(ident), ident, "left_anti"), "_x", ident, n - min(n, ranked.count()))
    return out(first, F.concat(F.lit("STRATUM_"), F.col(stratum).cast("string"))).unionByName(out(rest, F.lit("FILL")))


def paired_quota(df: DataFrame, by: str, positive: Column, order: Sequence[Column], cap: int, total: int) -> DataFrame:
    """df's rows with ``place``: of each key as many positives as negatives, at most cap of both, while all keys' pairs fit in total.

    Keys are served in their order; what earlier ones take is a sum over one
    row a key.
    """
    from pyspark.sql import Window

    side = F.coalesce(positive, F.lit(False))
    ranked = df.withColumn("_p", side).withColumn("place", F.row_number().over(Window.partitionBy(by, "_p").orderBy(*order))).filter(F.col("place") <= cap // 2)
    pairs = ranked.groupBy(by).agg(F.least(F.count_if("_p"), F.count_if(~F.col("_p"))).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a key
    room = pairs.withColumn("_n", F.greatest(F.lit(0), F.least(F.col("_n"), F.lit(total // 2) - before)))
    return ranked.join(room, by).filter(F.col("place") <= F.col("_n")).drop("_p", "_n")


def replaced(table: DataFrame, candidate: DataFrame, version: str, keys: Sequence[str], approved: bool) -> DataFrame:
    """table with the candidate's versions in place of its own, later rows of a key instead of earlier; table itself without approval."""
    if not approved:
        return table
    old = table.join(candidate.select(version).distinct(), version, "left_anti").withColumn("_new", F.lit(0))
    both = old.unionByName(candidate.withColumn("_new", F.lit(1)))
    rest = [c for c in table.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_new").alias("_s")).select(*keys, "_s.*").select(*table.columns)
