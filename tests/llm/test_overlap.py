import random

import numpy as np
import pytest
from sieveworks.llm import names, overlap
from sieveworks.llm.fmindex import Index


def slips(a, b):
    """0 for equal, 1 for one slip of a letter, else None."""
    if a == b:
        return 0
    n, m = len(a), len(b)
    p = next((i for i in range(min(n, m)) if a[i] != b[i]), min(n, m))
    s = next((i for i in range(min(n, m) - p) if a[n - 1 - i] != b[m - 1 - i]), min(n, m) - p)
    x, y = a[p : n - s], b[p : m - s]
    if (len(x), len(y)) in ((1, 0), (0, 1), (1, 1)) or (len(x) == len(y) == 2 and x == y[::-1]):
        return 1 if (x + y).isalpha() else None
    return None


@pytest.mark.parametrize("seed", range(6))
def test_search_against_all_pairs(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abc1 ") for _ in range(rng.randint(1, 7)))
    for _ in range(40):
        texts, patterns = sorted({word() for _ in range(rng.randint(1, 40))}), [word().replace("c", rng.choice("cz")) for _ in range(30)]
        tails = np.array([rng.randint(0, len(p)) for p in patterns])
        p, t, e, span = Index(texts).search(patterns, tails, True)
        assert all(x.endswith(y[len(y) - n :]) for x, y, n in zip((texts[j] for j in t), (patterns[i] for i in p), span))
        got = dict(zip(zip(p.tolist(), t.tolist()), e.tolist()))
        for i, a in enumerate(patterns):
            for j, b in enumerate(texts):
                want, k = slips(a, b), tails[i]
                if want is None:
                    assert (i, j) not in got
                elif want == 0 or k == 0 or a[len(a) - k :] == b[max(0, len(b) - k) :] and len(b) >= k and slips(a[: len(a) - k], b[: len(b) - k]) == 1:
                    assert got[i, j] == want


def test_exact_search_and_empty():
    assert Index([]).search(["a"], np.array([1]), True)[0].tolist() == []
    p, t, *_ = Index(["ab", "b"]).search(["b", "ab", "a", "é"], np.array([1, 2, 1, 1]), False)
    assert sorted(zip(p.tolist(), t.tolist())) == [(0, 1), (1, 0)]


VALID = "7732-18-5"
TRAIN = [
    ("a1", "Sodium 3-nitrobenzoate", VALID),
    ("a2", VALID, "sodium 3 - NITROBENZOATE"),
    ("a3", "3-nitrobenzoate, Sodium", None),
    ("a4", "Sodium 3-nitrobenzoate", "7732-18-4"),
    ("a5", "Zinc acetate", "50-00-0"),
    ("a6", None, None),
    ("a6", None, None),
    ("a7", "  ", "-"),
    ("a8", "Sodium 2-nitrobenzoate", "n/a"),
    (None, "Sodium 3-nitrobenzoate", VALID),
]
EVAL = [
    ("b1", "other name", "CAS No. 0007732-18-5"),
    ("b2", "odium 3-nitrobenzoate", "unknown"),
    ("b3", "Sodium 3-nitrobenzaote", ""),
    ("b4", "「zinc acetate」", None),
    ("b5", "Zinc acetate", "64-17-5"),
    ("b6", None, None),
    ("b7", "５０－００－０", "x"),
]


def test_pairs(spark):
    mk = lambda rows: spark.createDataFrame(rows, "id string, name string, number string").withColumnRenamed("id", "key")
    got = overlap.overlaps(overlap.substances(mk(TRAIN), "key", "name", "number"), overlap.substances(mk(EVAL), "key", "name", "number")).collect()
    pairs = {(r["train_id"], r["eval_id"]) for r in got}
    salts = {(a, b) for a in ("a1", "a2", "a3", "a4") for b in ("b2", "b3")}
    assert pairs == salts | {("a1", "b1"), ("a2", "b1"), ("a5", "b4"), ("a5", "b7")}
    assert len(got) == len(pairs)
    none = overlap.substances(mk(TRAIN).limit(0), "key", "name", "number")
    assert overlap.overlaps(none, none).count() == 0


def test_words_and_numbers(spark):
    df = spark.createDataFrame([("1 4:5,8-Di, Zinc", "(7732−18−5)"), ("N - oxide acid", "x"), ("3a ,4-y", "12")], "a string, b string")
    df = names.with_valid_number(names.with_substance(df, "a", "b"), "b")
    rows = df.select(names.name_words(df["a"]).alias("w"), "b").collect()
    assert [(r["w"], r["b"]) for r in rows] == [("1458di zinc", "7732185"), ("acid noxide", None), ("3a4y", None)]


def plain_pairs(train, evaluation):
    """Sorted words that differ in one word at most, and there by one slip."""
    def near(a, b):
        if a == b:
            return True
        a, b = a.split(), b.split()
        for x in {*a, ""}:
            for y in {*b, ""}:
                rest = lambda w, one: sorted(w) if one == "" else sorted([*w[: w.index(one)], *w[w.index(one) + 1 :]])
                if rest(a, x) == rest(b, y) and slips(x, y) == 1:
                    return True
        return False

    return {(i, j) for i, a, v in train for j, b, w in evaluation if (v and v == w) or (not (v and w) and near(a, b))}


@pytest.mark.parametrize("bounds", [(12_000, 300_000), (7, 300_000), (12_000, 5), (9, 11)])
def test_skewed_splits_against_all_pairs(spark, bounds):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 6)))
    bent = lambda w: w if rng.random() < 0.5 or len(w) < 2 else w[: (k := rng.randrange(len(w)))] + rng.choice(["", "e", "ba"]) + w[k + 1 :]
    stems = [word() for _ in range(25)]
    made = lambda: " ".join(sorted(w for w in (bent(w) for w in [rng.choice(stems), rng.choice(["acid", "acid", "salt", word()])] * rng.choice([1, 1, 2])) if w))
    rows = lambda c, n: [(f"{c}{i}", made(), rng.choice([None, None, "7732185", "50000"])) for i in range(n)]
    train, evaluation = rows("a", 150), rows("b", 90)
    mk = lambda r: spark.createDataFrame(r, "record_id string, name string, number string").selectExpr("record_id", "number", "nullif(name, '') as name")
    pairs = overlap.matched_keys
    try:
        overlap.matched_keys = lambda t, e: pairs(t, e, *bounds)
        got = {(r["train_id"], r["eval_id"]) for r in overlap.overlaps(mk(train), mk(evaluation)).collect()}
    finally:
        overlap.matched_keys = pairs
    assert got == plain_pairs(train, evaluation)


def test_names_of_very_many_words(spark):
    long = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400))
    mk = lambda i, n: spark.createDataFrame([(i, n, None), (i + "x", "other", None)], "key string, name string, number string")
    got = overlap.overlaps(overlap.substances(mk("a", long), "key", "name", "number"), overlap.substances(mk("b", long.replace("wab", "qab")), "key", "name", "number")).collect()
    assert {(r["train_id"], r["eval_id"], r["slips"]) for r in got} == {("a", "b", 1), ("ax", "bx", 0)}


def test_index_is_compressed():
    rng = random.Random(2)
    texts = sorted({"".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789-, ") for _ in range(25)) for _ in range(4000)})
    x = Index(texts)
    assert (x.bwt.nbytes + x.near.nbytes + x.far.nbytes) / x.n < 3
    symbols, at = np.array([rng.randrange(len(x.first)) for _ in range(500)]), np.array([rng.randrange(x.n + 1) for _ in range(500)])
    assert x.rank(symbols, at).tolist() == [int((x.bwt[:a] == c).sum()) for c, a in zip(symbols, at)]
