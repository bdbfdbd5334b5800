"""Versions, priorities, carried values and samples.

Where a key may hold most rows, an aggregate takes a window's place, or windows
run within blocks of the key and are put together from one row a block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, shuffle_width

def latest(df: DataFrame, version: Column, n: int = 2) -> DataFrame:
    """Rows of the n latest versions with their rank (1 is the latest); the versions are found by an aggregate of their own."""
    v = df.select(version.alias("_v")).filter("_v is not null").distinct()
    ranked = v.orderBy(F.desc("_v")).limit(n).withColumn("version_rank", F.row_number().over(Window.orderBy(F.desc("_v"))))
    return df.withColumn("_v", version).join(F.broadcast(ranked), "_v").drop("_v")


def filter_or_all(df: DataFrame, by: str, keep: Column) -> DataFrame:
    """Rows that meet the condition, or all rows of a key where none does."""
    some = df.filter(keep).select(by).distinct().withColumn("_some", F.lit(True))
    return df.join(some, by, "left").filter(keep | F.col("_some").isNull()).drop("_some")


def guarded(df: DataFrame, *conditions: Column) -> DataFrame:
    """df filtered by each condition in turn, but for those that would leave no row at all; one flag a condition is broadcast."""
    for keep in conditions:
        met = F.coalesce(keep, F.lit(False))
        some = df.agg(F.coalesce(F.bool_or(met), F.lit(False)).alias("_any"))
        df = df.crossJoin(F.broadcast(some)).filter(met | ~F.col("_any")).drop("_any")
    return df


def keep_first(df: DataFrame, by: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The first row of each key by order, with the number of rows, as an aggregate: a hot key needs no window."""
    return df.groupBy(*by).agg(F.min(F.struct(*order, *[v for v in values if v not in order])).alias("_m"), F.count(F.lit(1)).alias("n_copies")).select(*by, "_m.*", "n_copies")


def in_blocks(df: DataFrame, by: str, order: Sequence[str]) -> DataFrame:
    """df with _block: rows in ranges of (by, order), so that a hot key spans many tasks. Written once, as ranges are sampled."""
    n = shuffle_width(df.sparkSession)
    return cut(df.repartitionByRange(n, by, *order).withColumn("_block", F.spark_partition_id()))


def carried(df: DataFrame, by: str, order: Sequence[str], starts: Column, value: Column) -> DataFrame:
    """segment: number of starts so far; carried: the last value that isn't null.

    Windows run within blocks of a key; what earlier blocks of the key hand on
    comes from one row a block.
    """
    b = in_blocks(df.withColumns({"_s": F.when(starts, 1).otherwise(0), "_v": value}), by, order)
    w = Window.partitionBy(by, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = b.withColumns({"segment": F.sum("_s").over(w), "carried": F.last("_v", ignorenulls=True).over(w)})
    sums = b.groupBy(by, "_block").agg(F.sum("_s").alias("_n"), F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order))).alias("_last"))
    before = Window.partitionBy(by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    prior = sums.select(F.col(by).alias("_by"), F.col("_block").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.last("_last", ignorenulls=True).over(before).alias("_v0"))
    out = local.join(prior, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_block") == F.col("_b")))
    return out.withColumns({"segment": F.col("segment") + F.col("_n0"), "carried": F.coalesce("carried", "_v0")}).drop("_s", "_v", "_block", "_by", "_b", "_n0", "_v0")


def running_sums(df: DataFrame, by: str, order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """df with each value replaced by its sum over the rows of the key up to this one, put together by blocks."""
    b = in_blocks(df, by, order)
    w = Window.partitionBy(by, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = b.withColumns({v: F.sum(v).over(w) for v in values})
    sums = b.groupBy(F.col(by).alias("_by"), F.col("_block").alias("_b")).agg(*[F.sum(v).alias(f"_n_{v}") for v in values])
    before = Window.partitionBy("_by").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    prior = sums.select("_by", "_b", *[F.coalesce(F.sum(f"_n_{v}").over(before), F.lit(0)).alias(f"_n_{v}") for v in values])
    out = local.join(prior, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_block") == F.col("_b")))
    return out.withColumns({v: F.col(v) + F.col(f"_n_{v}") for v in values}).drop("_block", "_by", "_b", *[f"_n_{v}" for v in values])


def place(df: DataFrame, by: str, order: Sequence[str]) -> DataFrame:
    """df with place: row number within each key, counted by blocks."""
    b = in_blocks(df, by, order)
    local = b.withColumn("place", F.row_number().over(Window.partitionBy(by, "_block").orderBy(*order)).cast("long"))
    sums = b.groupBy(F.col(by).alias("_by"), F.col("_block").alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    prior = sums.withColumn("_n0", F.coalesce(F.sum("_n").over(Window.partitionBy("_by").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    out = local.join(prior, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_block") == F.col("_b")))
    return out.withColumn("place", F.col("place") + F.col("_n0")).drop("_block", "_by", "_b", "_n0")


def rising_segments(df: DataFrame, by: str, order: Sequence[str], number: Column) -> DataFrame:
    """df with segment: a new one begins where the number isn't above the last one of its key; counted by blocks."""
    b = in_blocks(df.withColumn("_n", number), by, order)
    w = Window.partitionBy(by, "_block").orderBy(*order)
    up_to = w.rowsBetween(Window.unboundedPreceding, -1)
    ends = b.groupBy(F.col(by).alias("_by"), F.col("_block").alias("_b")).agg(F.max_by("_n", F.when(F.col("_n").isNotNull(), F.struct(*order))).alias("_end"))
    before = Window.partitionBy("_by").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_end", F.last("_end", ignorenulls=True).over(before))
    met = b.withColumn("_last", F.last("_n", ignorenulls=True).over(up_to)).join(ends, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_block") == F.col("_b")))
    last = F.coalesce("_last", "_end")
    starts = F.when(F.col("_n").isNotNull() & (last.isNull() | (F.col("_n") <= last)), 1).otherwise(0)
    flagged = met.withColumn("segment", starts.cast("long")).drop("_n", "_block", "_last", "_by", "_b", "_end")
    return running_sums(flagged, by, order, ["segment"])


def numbered(df: DataFrame, order: Sequence[str], form: str) -> DataFrame:
    """df with id: row numbers in order, written by a format such as 'C%05d'; counted by blocks, so no task holds all rows."""
    return place(df.withColumn("_all", F.lit(0)), "_all", order).withColumn("id", F.format_string(form, "place")).drop("_all", "place")


def top_distinct(df: DataFrame, by: str, distinct: str, order: Sequence[Column], n: int) -> DataFrame:
    """The best n rows of each key, no two with the same ``distinct``."""
    # both are limits on a row number, which Spark applies before the shuffle too
    best = F.row_number().over(Window.partitionBy(by, distinct).orderBy(*order))
    top = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return df.withColumn("_b", best).filter("_b = 1").drop("_b").withColumn("place", top).filter(F.col("place") <= n)


def first_distinct(df: DataFrame, by: str, value: str, at: str, n: int, sep: str) -> DataFrame:
    """(by, joined, n_distinct): the first n distinct values of each key, joined in the order they came, and how many there are."""
    first = df.groupBy(by, value).agg(F.min(at).alias("_at"))
    place = F.row_number().over(Window.partitionBy(by).orderBy("_at", value))  # a limit, which is applied before the shuffle too
    few = first.withColumn("_p", place).filter(F.col("_p") <= n).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("_p", value))).alias("_v"))
    counts = first.groupBy(by).agg(F.count(F.lit(1)).alias("n_distinct"))
    return few.join(counts, by).select(by, F.array_join(F.col(f"_v.{value}"), sep).alias("joined"), "n_distinct")


def smallest(df: DataFrame, hashed: str, ident: str, n: int) -> DataFrame:
    """The n rows with the smallest hashes, ties by id; ``hashed`` is a column of hexadecimal digits.

    The last one is found in steps of 12 bits by counts of at most 4096 rows
    each; no task sorts or keeps more than what shares the last prefix.
    """
    rows = df.withColumn("_h", F.conv(F.substring(hashed, 1, 15), 16, 10).cast("long"))
    # all hashes below this prefix are taken, and what is left of n comes from the prefix itself
    prefix, bits, left, m = 0, 0, n, 0
    first = lambda b: F.shiftright("_h", 60 - b)
    while n > 0 and bits < 60:
        within = rows.filter(first(bits) == prefix) if bits else rows
        counts = sorted((r["_p"], r["n"]) for r in within.groupBy(first(bits + 12).alias("_p")).agg(F.count(F.lit(1)).alias("n")).collect())
        for prefix, m in counts:
            if left <= m:
                break
            left -= m
        else:
            return df  # no more rows than wanted
        bits += 12
        if m <= 1000:
            break
    if n <= 0:
        return df.limit(0)
    last = rows.filter(first(bits) == prefix).orderBy(hashed, ident).limit(left)  # of at most a thousand rows
    return rows.filter(first(bits) < prefix).unionByName(last).drop("_h")


def balanced(df: DataFrame, label: Column, ident: str, seed: str, ratio: float = 1.0) -> DataFrame:
    """All positives and at most ratio times as many negatives, those with the smallest seeded hashes."""
    pos, neg = df.filter(label), df.filter(~F.coalesce(label, F.lit(False)))
    hashed = neg.withColumn("_x", F.sha2(F.concat(F.lit(seed), F.col(ident).cast("string")), 256))
    return pos.unionByName(smallest(hashed, "_x", ident, int(round(pos.count() * ratio))).drop("_x"))
