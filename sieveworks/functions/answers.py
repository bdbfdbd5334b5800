"""JSON answers: the first object of a noisy text, label aliases, validation, payloads.

The scan for an object needs a parser's state and runs over Arrow batches;
everything else is column expressions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_THINK = re.compile(r"<think>.*?</think>", re.IGNORECASE | re.DOTALL)
_DECODER = json.JSONDecoder()


def _first(text: str | None) -> str | None:
    body = _THINK.sub("", text or "")
    at = body.find("{")
    while at >= 0:
        try:
            got, end = _DECODER.raw_decode(body, at)
            if isinstance(got, dict):
                return body[at:end]
        except (ValueError, RecursionError):
            pass
        at = body.find("{", at + 1)
    return None


@F.pandas_udf(StringType())
def _first_object(texts: pd.Series) -> pd.Series:
    return texts.map(_first)


def first_object(c: Column) -> Column:
    """The first complete JSON object of a text, past thinking blocks, fences, prose and broken starts; null for none."""
    return _first_object(c.cast("string"))


def with_aliases(c: Column, field: str, aliases: Mapping[str, str]) -> Column:
    """JSON text with a field's values brought to one vocabulary, without case."""
    for old, new in aliases.items():
        c = F.regexp_replace(c, rf'(?i)("{field}"\s*:\s*"){re.escape(old)}(")', f"$1{new}$2")
    return c


def validated(label: Column, flag: Column, quote: Column, confidence: Column, source: Column, allowed: Sequence[str], plain: str, manual: str) -> dict[str, Column]:
    """Columns of a checked answer.

    status OK for an allowed label, else ``manual``; the flag follows the label
    where it says enough; a quote counts as evidence only if it stands in the
    source; the confidence is a number between 0 and 1 or null.
    """
    given = F.upper(F.trim(F.coalesce(label, F.lit(""))))
    scope = F.when(given.isin(*allowed), given).otherwise(manual)
    said = F.lower(F.trim(flag.cast("string"))).isin("1", "true", "yes", "y")
    words = F.trim(F.coalesce(quote, F.lit("")))
    number = confidence.cast("string").try_cast("double")
    return {
        "scope": scope,
        "status": F.when(given.isin(*[a for a in allowed if a != manual]), "OK").otherwise(manual),
        "extended": F.when(scope == plain, False).when(scope != manual, True).otherwise(F.coalesce(said, F.lit(True))),
        "evidence": F.when((words != "") & F.contains(F.coalesce(source, F.lit("")), words), "EVIDENCE_EXACT_MATCH").otherwise("EVIDENCE_QUOTE_INVALID"),
        "confidence": F.when(~F.isnan(number), F.least(F.lit(1.0), F.greatest(F.lit(0.0), number))),
    }


def payload(columns: Mapping[str, Column]) -> Column:
    """A JSON object of the columns in order, nulls as empty texts."""
    return F.to_json(F.struct(*[F.coalesce(c.cast("string"), F.lit("")).alias(k) for k, c in columns.items()]))
