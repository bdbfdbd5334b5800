import itertools
import random
import re

from pyspark.sql import functions as F
from sieveworks.llm import dedupe

COLS = "id string, rule string, name string, number string, label string"


def copies(spark, rows):
    df = spark.createDataFrame(rows, COLS).withColumn("record_id", F.lit("clash"))
    return {(r["first_id"], r["copy_id"]) for r in dedupe.copies(dedupe.records(df, "t", "id", "rule", "name", "number", "label")).collect()}


def test_writing(spark):
    rows = [
        ("5", "R_1", "Zinc 3-x", "12-34-5", "MATCH"),
        ("2", " r_1​", "3 - X, ZINC", "'12−34−5", "match"),
        ("3", "R_1", "12 34 5", "[Zinc 3-x]", "Match"),
        ("4", "R_1", "Zinc 3-x", "12-34-6", "MATCH"),
        ("6", "R_1", "Zinc 3-y", "12-34-5", "MATCH"),
        ("7", "R_1", "Zinc 3-x", "", "MATCH"),
        ("8", "R_1", "Zinc 3-x", None, "MATCH"),
        ("9", "R_1", "-", "zinc 3-x", "MATCH"),
        ("7", "R_1", "Zinc 3-x", "", "MATCH"),
        ("A", "R_2", "Zinc 3-x", "12-34-5", "MATCH"),
        (None, "R_1", "Zinc 3-x", "12-34-5", "MATCH"),
    ]
    got = copies(spark, rows)
    assert {("2", "3"), ("2", "5"), ("7", "8")} <= got and not any({"4", "6", "A"} & set(p) for p in got)
    assert {("7", "9")} == got - {("2", "3"), ("2", "5"), ("7", "8")}


def test_same_letters_in_other_places_differ(spark):
    assert copies(spark, [("1", "r", "4-cyano-2-bromoxene", "1", "m"), ("2", "r", "2-cyano-4-bromoxene", "1", "m")]) == set()


def test_nulls_and_empty(spark):
    assert copies(spark, [("1", None, None, None, None), ("2", "", " ", "-", "")]) == {("1", "2")}
    assert copies(spark, []) == set()


def test_against_all_pairs_and_counts(spark):
    rng = random.Random(2)
    write = [str.upper, str.lower, lambda s: f'"{s}"', lambda s: s.replace("-", " - "), lambda s: f"  {s} ", lambda s: ", ".join(s.split(" ")[::-1])]
    base = [(f"{m} {n}-{x}ate", f"{k}-11-1") for m in ("zinc", "iron") for n in (2, 3) for x in ("nitro", "bromo") for k in (10, 11)]
    rows = []
    for i in range(400):
        name, number = rng.choice(base)
        rows.append((f"{i:04d}", "r", rng.choice(write)(name), number.replace("-", rng.choice("- ./")), "m"))
    words = lambda s: tuple(sorted(re.findall(r"[a-z0-9]+", s.lower().replace(" - ", "-").replace("-", ""))))
    key = {r[0]: (words(r[2]), re.sub(r"\D", "", r[3])) for r in rows}
    want = {(min(i for i in key if key[i] == k), j) for j, k in key.items()}
    assert copies(spark, rows) == {(a, b) for a, b in want if a != b}
    df = dedupe.records(spark.createDataFrame(rows, COLS), "t", "id", "rule", "name", "number", "label")
    kept = dedupe.collapsed(df).collect()
    assert sum(r["n_copies"] for r in kept) == 400 and len(kept) == len(set(key.values()))


def test_hot_classes_meet_in_parts(spark):
    rows = spark.range(1000).select(F.col("id").cast("string").alias("r"), F.when(F.col("id") % 3 == 0, "x").otherwise(F.col("id").cast("string")).alias("k"))
    classes = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert dedupe.spread_join(rows, classes, ["k"], "r", hot=50).count() == 1000


def test_histogram_is_blind_to_order_and_marks():
    import pyarrow as pa

    for a in itertools.permutations(["Zinc", " 3-", "x。"]):
        assert dedupe.histogram_hash(pa.array(["".join(a)]))[0] == dedupe.histogram_hash(pa.array(["zinc3x"]))[0]
    assert dedupe.histogram_hash(pa.array(["a", None, ""]).slice(1)).tolist() == [0, 0]


def test_histogram_hash_of_letters_beyond_ascii():
    import pyarrow as pa

    h = dedupe.histogram_hash(pa.array(["염산 나트륨", "나트륨-염산", "염산 칼륨", "Äpfel", "ÄPFEL ", "Apfel", None, "x"]).slice(0)).tolist()
    assert h[0] == h[1] != h[2] and h[3] == h[4] != h[5] and h[6] == 0 and dedupe.histogram_hash(pa.array(["q", "é a", "A É"]).slice(1)).tolist()[0] == dedupe.histogram_hash(pa.array(["A É"])).tolist()[0]
