import random

import pandas as pd
import pytest
from sieveworks.operators import reconcile as R

FIELDS = ["x", "y"]


def diff(spark, a, b, buckets=1):
    sides = [R.keyed(spark.createDataFrame(rows, "id string, x string, y string"), "d", side, "id", FIELDS) for side, rows in enumerate((a, b))]
    return sorted((r["record_id"], r["difference"]) for r in R.differences(sides[0].unionByName(sides[1]), {"d": FIELDS}, buckets).collect())


def test_writing_makes_no_difference(spark):
    a = [("1", " A–b ", "True"), ("2", None, "1"), ("3", "q", "x"), ("3", "q", "x")]
    b = [("1", "a-B", "1"), ("2", "  ", "TRUE"), ("3", "q", "X ")]
    assert diff(spark, a, b) == []


def test_kinds(spark):
    a = [("1", "p", "q"), ("2", "p", "q"), (None, "p", "q"), ("4", None, "q")]
    b = [("1", "p", "z"), ("3", "p", "q"), ("4", "p", "w")]
    assert diff(spark, a, b) == [("1", "y"), ("2", "only_first"), ("3", "only_second"), ("4", "x"), ("4", "y")]


def test_empty_sides(spark):
    assert diff(spark, [], [("1", "a", "b")]) == [("1", "only_second")]
    assert diff(spark, [], []) == []


@pytest.mark.parametrize("share", [0.02, 0.9])
def test_random_copies(spark, share):
    """A small share is peeled, a large one falls back; both are exact."""
    rng = random.Random(3)
    a = [(str(i), rng.choice("ab"), rng.choice("cd")) for i in range(3000)]
    b, want = [], []
    for i, x, y in a:
        if rng.random() < share:
            if rng.random() < 0.3:
                want.append((i, "only_first"))
                continue
            x = x + "!"
            want.append((i, "x"))
        b.append((i, x, y))
    assert diff(spark, a, b, 2) == sorted(want)


def test_check_hash_is_the_sessions(spark):
    h = spark.sql("select xxhash64(123L, -5L) h").first()["h"]
    assert R._check(123, -5) == h


def test_peeling_a_full_table_gives_up():
    cells = pd.DataFrame({"bucket": [0] * 3, "cell": [0, 1, 2], "n": [2, 2, 2], "kh": [1, 1, 1], "rh": [1, 1, 1], "ck": [1, 1, 1]})
    assert R.peel(cells)["sign"].tolist() == [0]


def test_buckets_that_span_batches():
    import pandas as pd
    import pyarrow as pa

    rows = []
    for bucket, keys in {1: [5, 6], 2: [7], 9: [8, 10, 11]}.items():
        cells = {}
        for k in keys:
            ck = R._check(k, k * 3)
            for j in range(R.PARTS):
                i = j * R.CELLS + ((ck >> (j * R.SHIFT)) & R.MASK) % R.CELLS
                c = cells.setdefault(i, [0, 0, 0, 0])
                cells[i] = [c[0] + 1, c[1] ^ k, c[2] ^ (k * 3), c[3] ^ ck]
        rows += [(bucket, i, *c) for i, c in cells.items()]
    df = pd.DataFrame(rows, columns=["bucket", "cell", "n", "kh", "rh", "ck"])
    for size in (1, 2, 5, 100):
        batches = [pa.RecordBatch.from_pandas(df.iloc[i : i + size], preserve_index=False) for i in range(0, len(df), size)]
        got = pd.concat([b.to_pandas() for b in R._peeled(iter(batches))])
        assert sorted(zip(got["bucket"], got["kh"], got["sign"])) == [(1, 5, 1), (1, 6, 1), (2, 7, 1), (9, 8, 1), (9, 10, 1), (9, 11, 1)]
