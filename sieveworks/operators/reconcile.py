"""Differences between two copies of a dataset, by invertible Bloom lookup tables.

Both copies are summed into small tables of cells per bucket of keys: each row
adds its key hash, row hash and check hash to three cells, the first copy with
weight 1 and the second with weight -1. Rows equal in both copies cancel out;
what is left is peeled from cells with a single row, which reveals the differing
keys. Only the rows of those keys are fetched and compared field by field.
A bucket that can't be peeled falls back to the list of all its row hashes, so
the result is exact whatever the share of differences.

Keys are unique within a copy but for repeated deliveries, which count once; of
deliveries with different content the one with the smallest row hash counts.
Null and blank keys take no part. Fields are compared in the form of
``value_form``. Where a copy is empty, all rows of the other are on one side
only. Extra columns of any name are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_blank, value_form
from ..session import cut

#: Rows of both copies per bucket, and cells of each of the three parts of its
#: table: room for differences of about two fifths of the bucket's rows.
BUCKET_ROWS = 4096
CELLS = 700
PARTS = 3
#: Bits of the check hash that choose the cell within one part.
SHIFT, MASK = 20, (1 << 20) - 1


def keyed(df: DataFrame, dataset: str, side: int, key: str, fields: Sequence[str], width: int | None = None) -> DataFrame:
    """(dataset, side, key, f0..): the fields as they stand, in order, padded with nulls to ``width`` of them."""
    n = width or len(fields)
    return df.select(
        F.lit(dataset).alias("dataset"),
        F.lit(side).alias("side"),
        strip_blank(F.col(key).cast("string")).alias("key"),
        *[(F.col(fields[i]).cast("string") if i < len(fields) else F.lit(None).cast("string")).alias(f"f{i}") for i in range(n)],
    ).filter(F.length("key") > 0)


def _check(kh: int, rh: int) -> int:
    """Spark's xxhash64(kh, rh)."""
    h = xxhash.xxh64_intdigest(struct.pack("<q", kh), 42)
    return struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(struct.pack("<q", rh), h)))[0]


def peel(cells: pd.DataFrame) -> pd.DataFrame:
    """Differing (bucket, kh, rh, sign) of one bucket; one row of sign 0 if it can't be peeled."""
    bucket = cells["bucket"].iloc[0]
    state = {i: [n, k, r, c] for i, n, k, r, c in zip(*(cells[x].tolist() for x in ("cell", "n", "kh", "rh", "ck")))}
    out: list[tuple[int, int, int, int]] = []
    stack = list(state)
    while stack:
        got = state.get(stack.pop())
        if got is None or abs(got[0]) != 1:
            continue
        sign, kh, rh, ck = got
        if _check(kh, rh) != ck:
            continue
        out.append((bucket, kh, rh, sign))
        for j in range(PARTS):
            i = j * CELLS + ((ck >> (j * SHIFT)) & MASK) % CELLS
            cell = state.setdefault(i, [0, 0, 0, 0])
            cell[0] -= sign
            cell[1] ^= kh
            cell[2] ^= rh
            cell[3] ^= ck
            if not any(cell):
                del state[i]
            elif abs(cell[0]) == 1:
                stack.append(i)
    if state:
        out = [(bucket, 0, 0, 0)]
    return pd.DataFrame(out, columns=["bucket", "kh", "rh", "sign"])


def _peeled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``peel`` of rows sorted by bucket; many buckets a batch, a bucket may span batches."""
    held: list[pd.DataFrame] = []

    def done(df: pd.DataFrame) -> pa.RecordBatch:
        parts = [peel(part) for _, part in df.groupby("bucket", sort=False)]
        return pa.RecordBatch.from_pandas(pd.concat(parts).astype({"bucket": "int32", "kh": "int64", "rh": "int64", "sign": "int32"}), preserve_index=False)

    for b in batches:
        held.append(b.to_pandas())
        last = held[-1]["bucket"].iloc[-1] if len(held[-1]) else None
        if last is None or held[0]["bucket"].iloc[0] == last:
            continue
        df = pd.concat(held)
        held = [df[df["bucket"] == last]]
        yield done(df[df["bucket"] != last])
    held = [h for h in held if len(h)]
    if held:
        yield done(pd.concat(held))


def cell_sums(items: DataFrame) -> DataFrame:
    """The subtracted tables: (bucket, cell, n, kh, rh, ck) of the cells that aren't empty."""
    ck = F.xxhash64("kh", "rh")
    index = [F.lit(j * CELLS) + F.shiftright("ck", j * SHIFT).bitwiseAND(F.lit(MASK)) % F.lit(CELLS) for j in range(PARTS)]
    return (
        items.select("bucket", "kh", "rh", F.when(F.col("side") == 0, 1).otherwise(-1).alias("sign"), ck.alias("ck"))
        .select("bucket", "kh", "rh", "sign", "ck", F.explode(F.array(*index)).alias("cell"))
        .groupBy("bucket", "cell")
        .agg(F.sum("sign").alias("n"), *[F.bit_xor(c).alias(c) for c in ("kh", "rh", "ck")])
        .filter("n <> 0 or kh <> 0 or rh <> 0 or ck <> 0")
    )


def differences(first_and_second: DataFrame, fields: dict[str, Sequence[str]], buckets: int) -> DataFrame:
    """(dataset, record_id, difference) of rows made by ``keyed``, both sides of all datasets on end.

    difference is only_first, only_second or the name of a differing field.
    Only hashes go through the first shuffle, by bucket, which serves the
    removal of repeated deliveries and the cell sums. The fields of the
    differing keys are fetched and brought to their compared form after that.
    """
    columns = [c for c in first_and_second.columns if c[0] == "f" and c[1:].isdigit()]
    form = lambda c: F.coalesce(value_form(F.col(c)), F.lit(""))
    rows = first_and_second.withColumn("kh", F.xxhash64("dataset", "key")).withColumn("bucket", F.pmod("kh", F.lit(buckets)).cast("int"))
    hashes = rows.select("bucket", "kh", "side", F.xxhash64(*[form(c) for c in columns]).alias("rh"))
    items = hashes.repartition("bucket").groupBy("bucket", "kh", "side").agg(F.min("rh").alias("rh"))
    # only cells that didn't cancel out are left
    peeled = cell_sums(items).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_peeled, "bucket int, kh long, rh long, sign int")
    stuck = peeled.filter("sign = 0").select("bucket")
    listed = items.join(stuck, "bucket").groupBy("bucket", "kh", "rh").agg(F.sum(F.when(F.col("side") == 0, 1).otherwise(-1)).alias("sign")).filter("sign <> 0")
    differing = peeled.filter("sign <> 0").select("bucket", "kh").unionByName(listed.select("bucket", "kh")).distinct()
    differing = cut(differing)  # peeled once, however many tables are fetched from
    fetched = rows.join(differing, ["bucket", "kh"], "left_semi").withColumns({"vals": F.array(*[form(c) for c in columns]), "rh": F.xxhash64(*[form(c) for c in columns])})
    side = lambda n: F.min_by(F.when(F.col("side") == n, F.col("vals")), F.when(F.col("side") == n, F.col("rh")))
    both = fetched.groupBy("bucket", "kh", "dataset", "key").agg(side(0).alias("a"), side(1).alias("b"))
    changed = F.lit(None).cast("array<string>")
    for dataset, names in fields.items():
        per_field = F.array_compact(F.array(*[F.when(F.col("a")[i] != F.col("b")[i], F.lit(n)) for i, n in enumerate(names)]))
        changed = F.when(F.col("dataset") == dataset, per_field).otherwise(changed)
    what = F.when(F.col("b").isNull(), F.array(F.lit("only_first"))).when(F.col("a").isNull(), F.array(F.lit("only_second"))).otherwise(changed)
    return both.select("dataset", F.col("key").alias("record_id"), F.explode(what).alias("difference"))


def bucket_count(rows: int) -> int:
    return max(1, -(-rows // BUCKET_ROWS))
