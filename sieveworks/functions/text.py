"""Text normalisation as column expressions (no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Visible and invisible blanks, dash forms (Java regex classes).
BLANK = r"[\s\u0085\u00a0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]"
DASH = r"[\u2010-\u2015\u2212\ufe58\ufe63\uff0d\u00ad]"

#: The same blanks as characters, for trimming without a regular expression.
BLANKS = " \t\n\r\f\v\x85\xa0\u1680\u180e\u2028\u2029\u202f\u205f\u2060\u3000\ufeff" + "".join(map(chr, range(0x2000, 0x200E)))

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))


def strip_blank(c: Column) -> Column:
    """Without outer blanks, visible or not; null stays null."""
    return F.btrim(c, F.lit(BLANKS))


def blank_to_null(c: Column) -> Column:
    s = strip_blank(c)
    return F.when(F.length(s) > 0, s)


def narrow(c: Column) -> Column:
    """Full-width ASCII forms to plain ASCII; rows without any are passed over."""
    return F.when(c.rlike(r"[\uff01-\uff5e]"), F.translate(c, _WIDE, _NARROW)).otherwise(c)


def key_form(c: Column) -> Column:
    """A key without outer blanks and letter case; blank keys become null."""
    return F.lower(blank_to_null(c))


def value_form(c: Column) -> Column:
    """A value for comparing two copies of a field.

    Letter case, outer blanks, kind of dash, blank against null and 1/0
    against true/false make no difference.
    """
    s = F.lower(F.regexp_replace(strip_blank(c), DASH, "-"))
    return F.when(s == "", None).when(s == "true", "1").when(s == "false", "0").otherwise(s)
