"""Named checks as rows, required columns, and frozen content hashes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check(df: DataFrame, name: str, bad: Column) -> DataFrame:
    """(check_name, n_rows, n_bad, status) of rows that break a condition."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(bad).alias("n_bad")).select(F.lit(name).alias("check_name"), "n_rows", "n_bad", F.when(F.col("n_bad") == 0, "PASS").otherwise("FAIL").alias("status"))


def unique(df: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    return check(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), name, F.col("_n") > 1)


def one_value(df: DataFrame, name: str, by: str, value: str) -> DataFrame:
    """Keys must have exactly one value that isn't blank."""
    filled = F.when(F.trim(F.col(value)) != "", F.col(value))
    return check(df.groupBy(by).agg(F.count_distinct(filled).alias("_n")), name, F.col("_n") != 1)


def all_checks(checks: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def require(df: DataFrame, needed: Sequence[str] = (), forbidden: Sequence[str] = ()) -> DataFrame:
    """df itself, or an error naming the columns that lack or mustn't be there."""
    lacking, extra = [c for c in needed if c not in df.columns], [c for c in forbidden if c in df.columns]
    if lacking or extra:
        raise ValueError(f"columns missing: {lacking}; columns not allowed: {extra}")
    return df


def resolve(df: DataFrame, candidates: Sequence[str]) -> str | None:
    """The first candidate that is a column, exactly or else without case."""
    lower: Mapping[str, str] = {c.lower(): c for c in reversed(df.columns)}
    return next((c for c in candidates if c in df.columns), next((lower[c.lower()] for c in candidates if c.lower() in lower), None))


def content_hash(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(n_rows, content_hash): independent of the order of rows; repeated rows count."""
    row = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0001")) for c in columns])
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum((row.bitwiseAND(F.lit((1 << 40) - 1)))).alias("content_hash"))


def warn(df: DataFrame, name: str, odd: Column) -> DataFrame:
    """A check that only warns."""
    return check(df, name, odd).withColumn("status", F.when(F.col("n_bad") == 0, "PASS").otherwise("WARN"))


def equal_counts(df: DataFrame, name: str, by: str, n: int) -> DataFrame:
    """Every group must have just n rows."""
    return check(df.groupBy(by).agg(F.count(F.lit(1)).alias("_n")), name, F.col("_n") != n)


def overall(checks: DataFrame) -> DataFrame:
    """(n_checks, n_fail, n_warn, status): FAIL if any check fails, else WARN if any warns."""
    c = checks.agg(F.count(F.lit(1)).alias("n_checks"), F.count_if(F.col("status") == "FAIL").alias("n_fail"), F.count_if(F.col("status") == "WARN").alias("n_warn"))
    return c.withColumn("status", F.when(F.col("n_fail") > 0, "FAIL").when(F.col("n_warn") > 0, "WARN").otherwise("PASS"))


def must_pass(checks: DataFrame) -> DataFrame:
    """checks itself, or an error naming those that fail."""
    bad = [r["check_name"] for r in checks.filter("status = 'FAIL'").orderBy("check_name").collect()]
    if bad:
        raise ValueError(f"checks failed: {', '.join(bad)}")
    return checks


def views(df: DataFrame, named: Mapping[str, Column]) -> DataFrame:
    """The rows of each named view on end, with its name; a row is in as many views as it meets."""
    tags = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in named.items()]))
    return df.withColumn("view", F.explode(tags))
