"""Rules read from running text: codes, numbers, groups and limits.

Each text is read on its own, in the JVM where a regular expression suffices;
the grouped list needs the order of its lines and runs as a small state machine
over Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.conditions import NUMBER_PATTERN

#: A designation code, a list item with its number, a numbered line, a limit.
CODE = r"(?<![\d-])(\d{2,4}-\d-\d{1,6})(?![\d-])"
_ITEM = re.compile(r"^(\d{1,3})\s+(.*?)\s*(\d{2,7}-\d{2}-\d)\s*$")
_REST = re.compile(r"^(\d{1,3})\s+(.+?)\s*-?\s*$")
LIMIT = r"(\d+(?:\.\d+)?)\s*%\s*(이상|초과|이하|미만)"


def designation_pairs(df: DataFrame, record_id: str, column: str) -> DataFrame:
    """(record_id, block, code, number): every number between one code and the next; codes without any have a null number.

    Text before the first code belongs to none.
    """
    marked = F.regexp_replace(F.col(column), CODE, "\u0001$1\u0002")
    blocks = df.select(F.col(record_id).alias("record_id"), F.posexplode(F.split(marked, "\u0001")).alias("block", "_t")).filter("block > 0")
    code, rest = F.substring_index("_t", "\u0002", 1), F.substring_index("_t", "\u0002", -1)
    numbers = F.array_distinct(F.regexp_extract_all(rest, F.lit(NUMBER_PATTERN), F.lit(1)))
    return blocks.select("record_id", "block", code.alias("code"), F.explode_outer(numbers).alias("number"))


def limits(df: DataFrame, record_id: str, column: str) -> DataFrame:
    """(record_id, ord, limit_pct, word): percent limits with the word that says on which side they hold."""
    found = F.regexp_extract_all(F.col(column), F.lit(LIMIT), F.lit(0))
    x = df.select(F.col(record_id).alias("record_id"), F.posexplode(found).alias("ord", "_m"))
    return x.select("record_id", "ord", F.regexp_extract("_m", LIMIT, 1).cast("double").alias("limit_pct"), F.regexp_extract("_m", LIMIT, 2).alias("word"))


def _groups(text: str) -> Iterator[tuple[int, str, int, str, str | None]]:
    """(group, title, item, name, number): numbering that doesn't rise begins the next group, its title is the line before."""
    group, last, title, waiting = 0, 0, "", ""
    for line in text.splitlines():
        line = line.strip()
        if not line:
            continue
        m = _ITEM.match(line)
        rest = None if m else _REST.match(line)
        if m or (rest and int(rest[1]) == last + 1):
            n = int((m or rest)[1])
            if n <= last or group == 0:
                group, title = group + 1, waiting
            last, waiting = n, ""
            yield group, title, n, (m or rest)[2], m[3] if m else None
        else:
            waiting = line


def grouped_list(df: DataFrame, record_id: str, column: str) -> DataFrame:
    """Numbered lists of a text, cut into groups where the numbering starts again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows = [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for x in _groups(text or ""):
                    ids.append(i)
                    rows.append(x)
            g = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, b.schema.field(0).type), pa.array(g[0], pa.int32()), pa.array(g[1], pa.string()), pa.array(g[2], pa.int32()), pa.array(g[3], pa.string()), pa.array(g[4], pa.string())],
                ["record_id", "grp", "title", "item", "name", "number"],
            )

    kind = df.schema[record_id].dataType.simpleString()
    return df.select(df[record_id].alias("record_id"), df[column].cast("string")).mapInArrow(run, f"record_id {kind}, grp int, title string, item int, name string, number string")
