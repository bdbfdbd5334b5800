"""References to records that don't exist, arrive later or were deleted.

A composite reference may be null in some of its columns. References are
grouped by their null mask, and each mask is matched on its non-null columns
against the target keys, under one of three declared semantics:

* ``simple``: a reference with any null isn't checked,
* ``partial``: the non-null columns must occur together in some target that is
  there, arrived and not deleted, when the record arrives,
* ``full``: a reference that is null in some but not all columns is missing.

A reference null in all its columns is never a case. Repeated deliveries of a
record count once, at the earliest time. Empty tables give an empty result;
extra columns of any name are ignored, as inputs are projected first.

References of a hot key meet it in as many parts as their number asks. Where a
mask leaves columns out, many targets share its key: their arrivals and
deletions are counted along time in range blocks, so that a key that most
targets share needs neither a list nor a task of its own.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import key_form
from . import windows
from .spread import HOT, spread_join


def references(df: DataFrame, table_name: str, record_id: str, target: str, keys: Sequence[str], seen_at: str) -> DataFrame:
    """Rows (table_name, record_id, target, k0.., seen_at) of one table's references."""
    return df.select(
        F.lit(table_name).alias("table_name"),
        F.col(record_id).cast("string").alias("record_id"),
        F.lit(target).alias("target"),
        *[key_form(F.col(k).cast("string")).alias(f"k{i}") for i, k in enumerate(keys)],
        F.col(seen_at).alias("seen_at"),
    )


def targets(df: DataFrame, target: str | Column, keys: Sequence[str], first_at: str | None, deleted_at: str | None = None) -> DataFrame:
    """Rows (target, k0.., first_at, deleted_at); first_at null marks a mere deletion."""
    when = lambda c: F.col(c).cast("timestamp") if c else F.lit(None).cast("timestamp")
    return df.select(
        (F.lit(target) if isinstance(target, str) else target).alias("target"),
        *[key_form(F.col(k).cast("string")).alias(f"k{i}") for i, k in enumerate(keys)],
        when(first_at).alias("first_at"),
        when(deleted_at).alias("deleted_at"),
    )


def find_orphans(refs: DataFrame, keys_of: DataFrame, n_keys: int = 1, match: str = "simple", hot: int = HOT) -> DataFrame:
    """(table_name, record_id, reason, seen_at) of each reference without a valid target.

    reason: ``missing`` no such key; ``late`` the key's first arrival is after
    the record's; ``deleted`` its deletion isn't after the record's arrival.
    A partial reference is late if all its targets arrive after it, and
    deleted if those that were there before it are all deleted.
    """
    if match not in ("simple", "partial", "full"):
        raise ValueError(f"unknown match semantics {match!r}")
    ks = [f"k{i}" for i in range(n_keys)]
    once = refs.groupBy("table_name", "record_id", "target", *ks).agg(F.min("seen_at").alias("seen_at"))
    known = keys_of.groupBy("target", *ks).agg(F.min("first_at").alias("first_at"), F.min("deleted_at").alias("deleted_at")).filter(F.col("first_at").isNotNull())
    parts = []
    for mask in product([True, False], repeat=n_keys):
        there = [k for k, x in zip(ks, mask) if x]
        if not there or (match == "simple" and len(there) < n_keys):
            continue
        cond = reduce(lambda a, b: a & b, [F.col(k).isNotNull() if x else F.col(k).isNull() for k, x in zip(ks, mask)])
        mine = once.filter(cond)
        if match == "full" and len(there) < n_keys:
            parts.append(mine.select("table_name", "record_id", F.lit("missing").alias("reason"), "seen_at"))
        elif len(there) < n_keys:
            parts.append(_any_target(mine, known.dropna(subset=there), there))
        else:
            parts.append(_one_target(mine, refs.filter(cond), known.dropna(subset=there), there, hot))
    return reduce(DataFrame.unionByName, parts)


def _one_target(once: DataFrame, refs: DataFrame, known: DataFrame, there: Sequence[str], hot: int) -> DataFrame:
    """Orphans among references whose columns are a whole key."""
    sizes = refs.groupBy("target", *there).agg(F.count(F.lit(1)).alias("n"))
    classes = known.join(sizes, ["target", *there]).select("target", *there, "n", "first_at", "deleted_at")
    reason = F.when(F.col("first_at").isNull(), "missing").when(F.col("deleted_at") <= F.col("seen_at"), "deleted").when(F.col("first_at") > F.col("seen_at"), "late")
    met = spread_join(once, classes, ["target", *there], "record_id", hot, "left")
    return met.select("table_name", "record_id", reason.alias("reason"), "seen_at").filter(F.col("reason").isNotNull())


def _any_target(once: DataFrame, known: DataFrame, there: Sequence[str]) -> DataFrame:
    """Orphans among references that any target with these columns satisfies."""
    key = F.xxhash64("target", *there)
    wanted = once.select(key.alias("_key")).distinct()
    events = known.select(key.alias("_key"), F.explode(F.array(
        F.struct(F.col("first_at").alias("at"), F.lit(1).alias("come"), F.lit(0).alias("go")),
        F.struct(F.greatest("first_at", "deleted_at").alias("at"), F.lit(0).alias("come"), F.when(F.col("deleted_at").isNotNull(), 1).otherwise(0).alias("go")),
    )).alias("_e")).select("_key", "_e.*").filter("come + go > 0").join(wanted, "_key", "left_semi")
    none = F.lit(None).cast("string")
    # what happens at the time of a record's arrival counts before it
    lines = events.select("_key", "at", F.lit(0).alias("_side"), none.alias("table_name"), none.alias("record_id"), "come", "go").unionByName(
        once.select(key.alias("_key"), F.col("seen_at").alias("at"), F.lit(1).alias("_side"), "table_name", "record_id", F.lit(0).alias("come"), F.lit(0).alias("go"))
    )
    run = windows.running_sums(lines, "_key", ["at", "_side", "table_name", "record_id"], ["come", "go"])
    targets_of = known.groupBy(key.alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    seen = run.filter("_side = 1").join(targets_of, "_key", "left")
    reason = F.when(F.col("_n").isNull(), "missing").when(F.col("come") == 0, "late").when(F.col("come") <= F.col("go"), "deleted")
    return seen.select("table_name", "record_id", reason.alias("reason"), F.col("at").alias("seen_at")).filter(F.col("reason").isNotNull())


def orphan_counts(found: DataFrame) -> DataFrame:
    """Orphans per table, month of arrival and reason."""
    return found.groupBy("table_name", F.date_format("seen_at", "yyyy-MM").alias("month"), "reason").agg(F.count(F.lit(1)).alias("n"))
