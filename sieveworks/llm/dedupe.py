"""Duplicates hidden by formatting, by progressive partition refinement.

Rows are first classed by cheap invariants that no difference of writing can
change: the number of letters and digits and their histogram, as a commutative
hash over the byte buffers. Only inside classes with several members the
costlier keys (sorted words, number, rule, label) are made and classed again.

Case, blanks (visible or not), punctuation, word order, width of characters
and a swap of name and number don't matter; letters and digits do. A missing
number, however written, equals only a missing one; null and blank are the
same. Repeated deliveries of an id are one record. Singles, empty tables and
rows without a name give no rows of their own in ``copies``; rows whose fields
are all empty are copies of each other only if all four fields agree.

A class or group may hold most rows: sizes are counted with partial
aggregation, and rows of a hot class meet it in as many parts as its size asks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import narrow
from ..operators.spread import spread_join
from ..session import cut
from . import names

_SEEDED = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64)
_WEIGHT = np.zeros(256, np.uint64)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789":
    _WEIGHT[_c] = _SEEDED[_c]
    _WEIGHT[ord(chr(_c).upper())] = _SEEDED[_c]


def _weights(points: np.ndarray) -> np.ndarray:
    """Weight of each code point: that of its lower case if it is a letter or digit beyond ASCII, else 0."""
    low = np.array([ord(chr(p).lower()[0]) if p > 127 and chr(p).isalnum() else 0 for p in points.tolist()], np.uint64)
    with np.errstate(over="ignore"):
        h = low * np.uint64(0x9E3779B97F4A7C15)
        return np.where(low > 0, (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9), np.uint64(0))


def histogram_hash(values: pa.Array) -> np.ndarray:
    """Commutative hash of each value's letters and digits, case aside."""
    values = values.cast(pa.large_string())
    if values.null_count:
        values = values.fill_null("")
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64)
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + n + 1]
    body = values.buffers()[2]
    data = np.frombuffer(body, np.uint8)[: offsets[-1]] if body is not None else np.zeros(0, np.uint8)
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_WEIGHT[data], dtype=np.uint64)])
    out = run[offsets[1:]] - run[offsets[:-1]]
    wide = np.concatenate([[0], np.cumsum(data > 127)])
    at = np.flatnonzero(wide[offsets[1:]] > wide[offsets[:-1]])
    if len(at):
        texts = values.take(pa.array(at)).to_pylist()
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        known, which = np.unique(points, return_inverse=True)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_weights(known)[which.reshape(-1)], dtype=np.uint64)])
        ends = np.cumsum([len(t) for t in texts])
        out[at] += sums[ends] - sums[np.concatenate([[0], ends[:-1]])]
    return out


def _invariants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    mix = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
    for b in batches:
        rule, name, number, label = (histogram_hash(b.column(i)) for i in (2, 3, 4, 5))
        h = (name + number) * mix[0] + rule * mix[1] + label * mix[2]
        h ^= h >> np.uint64(31)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(h.astype(np.int64))], [*b.schema.names, "cheap"])


def records(df: DataFrame, table_name: str, record_id: str, rule: str, name: str, number: str, label: str) -> DataFrame:
    text = lambda c: F.coalesce(narrow(F.col(c).cast("string")), F.lit(""))
    return df.select(F.lit(table_name).alias("table_name"), F.col(record_id).cast("string").alias("record_id"), text(rule).alias("rule"), text(name).alias("name"), text(number).alias("number"), text(label).alias("label")).filter(F.col("record_id").isNotNull())


def classes(rows: DataFrame) -> DataFrame:
    """(table_name, record_id, cheap, exact) of rows whose cheap class has several ids."""
    # words for "missing" would count as letters
    blank = lambda c: F.when(F.lower(F.trim(c)).rlike(names.MISSING), "").otherwise(c)
    rows = rows.withColumn("name", blank(F.col("name"))).withColumn("number", blank(F.col("number")))
    first = rows.mapInArrow(_invariants, "table_name string, record_id string, rule string, name string, number string, label string, cheap long")
    several = first.groupBy("table_name", "cheap").agg(F.min("record_id").alias("lo"), F.max("record_id").alias("hi"), F.count(F.lit(1)).alias("n")).filter("lo <> hi").drop("lo", "hi")
    inside = spread_join(first, several, ["table_name", "cheap"], "record_id")
    inside = names.with_plain(names.with_substance(inside, "name", "number"), ["rule", "label"])
    bare = lambda c: F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " "))
    exact = F.xxhash64(bare("rule"), F.lit("|"), names.name_words(F.col("name")), F.lit("|"), names.digits(F.col("number")), F.lit("|"), bare("label"))
    return inside.select("table_name", "record_id", "cheap", exact.alias("exact"))


def copies(rows: DataFrame) -> DataFrame:
    """(table_name, first_id, copy_id): each id that repeats the record of a smaller one."""
    inside = cut(classes(rows))
    groups = inside.groupBy("table_name", "cheap", "exact").agg(F.min("record_id").alias("first_id"), F.max("record_id").alias("hi"), F.count(F.lit(1)).alias("n")).filter("first_id <> hi").drop("hi")
    found = spread_join(inside, groups, ["table_name", "cheap", "exact"], "record_id")
    return found.filter("record_id <> first_id").select("table_name", "first_id", F.col("record_id").alias("copy_id")).distinct()


def collapsed(rows: DataFrame) -> DataFrame:
    """(table_name, record_id, n_copies): one row per record, with the number of ids it stands under."""
    found = cut(copies(rows))
    more = found.groupBy("table_name", F.col("first_id").alias("record_id")).agg((F.count(F.lit(1)) + 1).alias("n_copies"))
    kept = rows.select("table_name", "record_id").distinct().join(found.select("table_name", F.col("copy_id").alias("record_id")), ["table_name", "record_id"], "left_anti")
    return kept.join(more, ["table_name", "record_id"], "left").select("table_name", "record_id", F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"))
