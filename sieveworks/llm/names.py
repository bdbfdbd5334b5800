"""Canonical forms of a substance's name and registry number.

Name and number may stand in each other's field and be written in many ways;
``with_substance`` tells them apart and ``name_words`` / ``digits`` bring each
to one form. Nulls and blanks are empty strings here. The steps are projections
of their own, so that the optimizer evaluates each expression once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import DASH, narrow

#: What stands for a missing number.
MISSING = r"^(n/?a|n\.a\.|unknown|none|null|nan|<na>|없음|미상)?$"
_HIDDEN = r"[\u00ad\u180e\u200b-\u200d\u2060\ufeff]"
_SPACE = r"[\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
#: Blanks and marks inside locants, marks without blanks, dashes, and blanks after a locant or a single letter join the parts of one word.
_JOIN = r"(?<=[0-9]|[0-9][a-z])[ ,.:;'’]+(?=[0-9])|(?<=[\p{L}\p{N}])[,.:;](?=[\p{L}\p{N}])| +[,.:](?=[\p{L}\p{N}])| *[-/_]+ *|(?<=[0-9]) +(?=\p{L})|(?<=(?:^|[ ,;(\[\"'「*])\p{L}) +(?=\p{L})"


def with_plain(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df with the columns in lower case, narrow, with one kind of blank and dash and no invisible characters."""
    df = df.withColumns({c: F.lower(narrow(F.coalesce(F.col(c).cast("string"), F.lit("")))) for c in columns})
    clean = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, _HIDDEN, ""), _SPACE, " "), DASH, "-")
    return df.withColumns({c: F.trim(F.when(F.col(c).rlike(r"[^\x20-\x7e]"), clean(F.col(c))).otherwise(F.col(c))) for c in columns})


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def with_substance(df: DataFrame, name: str, number: str) -> DataFrame:
    """df with the two fields plain and in their places, whichever stood in which.

    A number has five or more digits and, but for words around it, less
    letters than digits; a field that only says it is missing is empty.
    """
    df = with_plain(df, [name, number])
    df = df.withColumns({c: F.when(~F.col(c).rlike(r"[\p{L}\p{N}]") | F.col(c).rlike(MISSING), "").otherwise(F.col(c)) for c in (name, number)})
    df = df.withColumns({f"_{i}": digits(F.col(c)) for i, c in enumerate((name, number))})
    looks = [(F.length(f"_{i}") >= 5) & (~F.col(c).rlike(r"\p{L}{12}") | (F.length(F.regexp_replace(c, r"[^\p{L}]", "")) < F.length(f"_{i}"))) for i, c in enumerate((name, number))]
    df = df.withColumns({"_0": looks[0], "_1": looks[1]})
    df = df.withColumn("_0", ~F.col("_1") & (F.col("_0") | (F.col(name) == "")))
    return df.withColumns({name: F.when(F.col("_0"), F.col(number)).otherwise(F.col(name)), number: F.when(F.col("_0"), F.col(name)).otherwise(F.col(number))}).drop("_0", "_1")


def name_words(c: Column) -> Column:
    """Sorted words of a plain name, without punctuation, joined by blanks."""
    joined = F.regexp_replace(c, _JOIN, "")
    spaced = F.regexp_replace(F.regexp_replace(joined, "[,;]", " "), r"[^\p{L}\p{N} ]", "")
    return F.array_join(F.array_sort(F.filter(F.split(spaced, " +"), lambda w: w != "")), " ")


def check_digit_ok(number: Column) -> Column:
    """Registry number (5 to 10 digits, no leading zeros) with a right check digit."""
    n = number.cast("long")
    weighted = sum((F.floor(n / F.lit(10**i)) % 10 * F.lit(i) for i in range(2, 10)), F.floor(n / F.lit(10)) % 10)
    return weighted % 10 == n % 10


def with_valid_number(df: DataFrame, number: str) -> DataFrame:
    """df with the column reduced to the digits of a valid registry number, or null."""
    df = df.withColumn(number, F.regexp_replace(digits(F.col(number)), "^0+", ""))
    return df.withColumn(number, F.when(F.length(number).between(5, 10), F.col(number))).withColumn(number, F.when(check_digit_ok(F.col(number)), F.col(number)))
