"""Identifiers, numbers and conditions read from text, as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of the domain's texts.
NUMBER_PATTERN = r"(?<!\d)(\d{2,7}-\d{2}-\d)(?!\d)"
PERCENT_CONDITION = r"(이상|초과|이하|미만|>=|>|<=|<)?\s*(\d+(?:\.\d+)?)\s*(?:%|퍼센트)"
QUANTITY_CONDITION = r"(?iU)(\d+(?:\.\d+)?)\s*(kg|킬로그램|ton|tons|톤|t)\b"

#: Words for a missing value and for true, by dialect.
NULL_WORDS = {"bare": (), "plain": ("nan", "none", "null"), "wide": ("nan", "none", "null", "<na>")}
TRUE_WORDS = {
    "approval": ("1", "true", "yes", "y", "validated", "approved", "예"),
    "short": ("1", "true", "yes", "y", "예", "o"),
    "answer": ("1", "true", "yes", "y", "예", "맞음"),
    "relation": ("1", "true", "yes", "y", "validated"),
}


def clean(c: Column, dialect: str = "plain") -> Column:
    """Trimmed text; null and words for null become ''."""
    t = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    return F.when(F.lower(t).isin(*NULL_WORDS[dialect]), "").otherwise(t)


def is_true(c: Column, dialect: str = "approval") -> Column:
    return F.lower(F.trim(F.coalesce(c.cast("string"), F.lit("")))).isin(*TRUE_WORDS[dialect])


def one_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def name_tokens(c: Column) -> Column:
    """Lower case ASCII letters and digits, all else one blank."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def head_and_tail(c: Column, most: int, marker: str = " ... ", least_tail: int = 400) -> Column:
    """A text longer than ``most`` as its head and tail around a marker."""
    tail = max(min(least_tail, most), most // 3)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, max(0, most - tail)), F.lit(marker), F.right(c, F.lit(tail))))


def numbers_in(c: Column) -> Column:
    """Registry numbers of a text in order, each once."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(NUMBER_PATTERN), F.lit(1)))


def check_digit(number: Column) -> Column:
    """Whether a number's last digit is the weighted sum of the others; null for null, false for blank."""
    d = F.regexp_replace(number, r"[^0-9]", "")
    body = F.reverse(F.substring(d, F.lit(1), F.length(d) - 1))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(9)), F.lit(0), lambda a, i: a + i * F.coalesce(F.substr(body, i, F.lit(1)).try_cast("int"), F.lit(0)))
    return number.rlike(r"^\d{2,7}-\d{2}-\d$") & (total % 10 == F.right(d, F.lit(1)).try_cast("int"))


def threshold(c: Column) -> Column:
    """The leading number of '0.1 %', '0.1 이상'; '-' and blanks are missing."""
    return F.regexp_extract(F.trim(c), r"^(\d+(?:\.\d+)?)", 1).try_cast("double")


def percents(c: Column) -> Column:
    """Percent conditions of a text in order."""
    return F.transform(F.regexp_extract_all(c, F.lit(PERCENT_CONDITION), F.lit(2)), lambda x: x.try_cast("double"))


def percent_operators(c: Column) -> Column:
    """What stands before each of the ``percents``, '' for none."""
    return F.regexp_extract_all(c, F.lit(PERCENT_CONDITION), F.lit(1))


def quantity(c: Column) -> tuple[Column, Column]:
    """(number, unit) of the first quantity of a text; null and '' for none."""
    return F.regexp_extract(c, QUANTITY_CONDITION, 1).try_cast("double"), F.lower(F.regexp_extract(c, QUANTITY_CONDITION, 2))


def echoed(c: Column, pattern: str) -> Column:
    """The text itself where it says what the pattern looks for, else ''."""
    return F.when(c.rlike(pattern), c).otherwise("")


def first_class(cases: Sequence[tuple[Column, str]], otherwise: str) -> Column:
    """The label of the first condition that holds; a null condition doesn't."""
    return F.coalesce(*[F.when(cond, label) for cond, label in cases], F.lit(otherwise))


def joined_labels(flags: Mapping[str, Column], sep: str = ";") -> Column:
    """Labels whose condition holds, in order."""
    return F.array_join(F.array_compact(F.array(*[F.when(cond, F.lit(label)) for label, cond in flags.items()])), sep)


def stable_id(prefix: str, parts: Sequence[Column], size: int = 16) -> Column:
    """A short id of the parts' normalised content."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *[one_space(F.coalesce(p, F.lit(""))) for p in parts]), 256), 1, size))


def route_rank(c: Column, ranks: Mapping[str, int], default: int = 9) -> Column:
    return reduce(lambda w, kv: w.when(c == kv[0], kv[1]), list(ranks.items())[1:], F.when(c == next(iter(ranks)), next(iter(ranks.values())))).otherwise(default)
