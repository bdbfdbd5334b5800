"""Joins whose keys may be shared by a large part of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one key that one task may get.
HOT = 200_000


def spread_join(rows: DataFrame, classes: DataFrame, keys: Sequence[str], by: str | Column, hot: int = HOT, how: str = "inner") -> DataFrame:
    """rows joined with classes (keys.., n, ..) on keys, hot classes in parts of at most about ``hot`` rows.

    n is the number of rows of the class; ``by`` is what rows of one class are
    told apart by. The list of hot classes has at most rows / hot entries.
    """
    parts = F.ceil(F.col("n") / F.lit(hot)).cast("int")
    few = classes.filter(F.col("n") > hot).select(*keys, parts.alias("_parts")).distinct()
    salted = rows.join(F.broadcast(few), list(keys), "left").withColumn("_salt", F.pmod(F.xxhash64(by), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    return salted.join(classes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1))), [*keys, "_salt"], how).drop("_salt")
