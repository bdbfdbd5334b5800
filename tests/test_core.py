import fractions
import math

import pytest
from pyspark.sql import functions as F
from sieveworks.functions import answers
from sieveworks.functions import conditions as C
from sieveworks.functions import text
from sieveworks.operators import diff, metrics, quality, screen, votes, windows
from sieveworks.sources import blocks, tables


def one(spark, expr, **values):
    names = list(values)
    kinds = {str: "string", float: "double", int: "long", bool: "boolean", type(None): "string"}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {kinds[type(values[n])]}" for n in names))
    return df.select(expr.alias("r")).first()["r"]


@pytest.mark.parametrize("number, ok", [("532-32-1", True), ("3084-48-0", False), ("3084-48-8", True), ("", False), ("abc", False)])
def test_check_digit(spark, number, ok):
    assert bool(one(spark, C.check_digit(F.col("n")), n=number)) is ok


def test_extraction_and_thresholds(spark):
    assert one(spark, C.numbers_in(F.col("t")), t="Benzidine(92-87-5) and its salts 92-87-5") == ["92-87-5"]
    assert one(spark, C.numbers_in(F.col("t")), t="999999992-87-55") == []
    for t, want in {"0.1%": 0.1, "-": None, "": None, "0.1 이상": 0.1}.items():
        assert one(spark, C.threshold(F.col("t")), t=t) == want
    assert one(spark, C.clean(F.col("t")), t=" NaN ") == "" and one(spark, C.clean(F.col("t")), t=None) == ""
    assert one(spark, C.clean(F.col("t")), t="<NA>") == "<NA>" and one(spark, C.clean(F.col("t"), "wide"), t="<NA>") == ""
    assert one(spark, answers.first_object(F.col("t")), t='<think>{"no":1}</think>text ```json\n{"a": 1}``` end') == '{"a": 1}'
    assert one(spark, C.head_and_tail(F.col("t"), 9, "..", 3), t="abcdefghijkl") == "abcdef..jkl"


def test_values_in_one_form(spark):
    assert one(spark, text.value_form(F.col("t")), t="　TRUE​") == "1"
    assert one(spark, text.value_form(F.col("t")), t="  ") is None
    assert one(spark, text.narrow(F.col("t")), t="ＡＢ１，") == "AB1,"


@pytest.mark.parametrize("old, new, want", [(1.0, 0.5, "strengthened"), (0.5, 1.0, "relaxed"), (1.0, 1.0 + 1e-13, "maintained")])
def test_direction(spark, old, new, want):
    assert one(spark, screen.direction(F.col("a"), F.col("b")), a=old, b=new) == want


@pytest.mark.parametrize(
    "labels, want",
    [("maintained,strengthened", "strengthened"), ("maintained,relaxed", "mixed"), ("relaxed", "relaxed"), ("deleted,maintained", "mixed"), ("", "mixed"), ("review,relaxed", "review"), ("deleted", "deleted")],
)
def test_overall_label(spark, labels, want):
    arr = F.filter(F.split("l", ","), lambda x: x != "")
    assert one(spark, diff.overall_label(arr), l=labels) == want


def test_meets_and_status(spark):
    assert one(spark, screen.meets(F.col("v"), F.lit(0.1), F.lit(">=")), v=0.1) is True
    assert one(spark, screen.meets(F.col("v"), F.lit(0.1), F.lit(">")), v=0.1) is False
    assert one(spark, screen.meets(F.col("v"), F.lit(0.1), F.lit("=")), v=0.1) is None
    assert one(spark, screen.status(F.col("v"), F.lit(None).cast("double"), F.lit(None).cast("boolean")), v=0.1) == "LIMIT_MISSING"


def test_every_spec_meets_every_item(spark):
    items = spark.createDataFrame([("x", 1), ("x", 5), ("y", 5), (None, None)], "kind string, v int")
    specs = spark.createDataFrame([("x", "V", 3), ("y", "V", 9), ("z", "OTHER", 0), ("w", None, 0)], "kind string, mode string, low int")
    got = screen.every_spec(items, specs, ["kind"], {"V": ("v", F.col("v") >= F.col("low"))}, "REVIEW").collect()
    assert {tuple(r) for r in got} == {("x", "V", "MATCH", 2), ("x", "V", "NO_MATCH", 2), ("y", "V", "NO_MATCH", 4), ("z", "OTHER", "REVIEW", 4), ("w", None, "REVIEW", 4)}
    assert screen.every_spec(items.limit(0), specs, ["kind"], {"V": ("v", F.col("v") >= F.col("low"))}, "REVIEW").count() == 0


@pytest.mark.parametrize("cast, want", [("MMN", "M"), ("MNR", "R"), ("MN", "R"), ("xxM", "R"), ("M", "M")])
def test_majority(spark, cast, want):
    df = spark.createDataFrame([("u", c) for c in cast], "u string, v string")
    assert votes.majority(df, ["u"], F.col("v"), ["M", "N"], "R").first()["decision"] == want
    assert votes.majority(df.limit(0), ["u"], F.col("v"), ["M"], "R").count() == 0


def test_statistics(spark):
    assert abs(one(spark, metrics.mcnemar_p(F.col("a"), F.col("b")), a=3, b=9) - 0.14599609375) < 1e-9
    assert one(spark, metrics.mcnemar_p(F.col("a"), F.col("b")), a=0, b=0) == 1.0
    assert one(spark, metrics.mcnemar_p(F.col("a"), F.col("b")), a=1000, b=1000) == 1.0
    low, high = metrics.wilson(F.col("k"), F.col("n"))
    assert one(spark, low, k=0, n=0) is None and one(spark, low, k=0, n=10) == 0.0 and one(spark, high, k=10, n=10) == 1.0
    same = spark.createDataFrame([("a", "a")] * 3, "x string, y string")
    assert metrics.kappa(same, "x", "y").first()["kappa"] is None
    gaps = spark.createDataFrame([("a", None), ("", "b"), ("a", "b")], "x string, y string")
    assert metrics.macro_f1(gaps, "x", "y").first()["n"] == 1
    assert math.isclose(metrics.with_total(spark.createDataFrame([("a",), (None,)], "s string"), "s").filter("s = 'TOTAL'").first()["share"], 1.0)


def many_pairs(a, b):
    """All terms as whole numbers; those below 1e-40 of a tail's top can't be told in a float, yet count here."""
    n, k = a + b, min(a, b)
    term = total = math.comb(n, k)
    for i in range(k, 0, -1):
        term = term * i // (n - i + 1)
        if not term:
            break
        total += term
    return min(1.0, float(fractions.Fraction(2 * total, 2**n)))


@pytest.mark.parametrize("a, b", [(60_000, 60_000), (50_500, 50_600), (50_300, 49_800), (51_000, 50_000), (0, 200_000), (20_000, 90_000)])
def test_mcnemar_of_many_pairs(spark, a, b):
    assert abs(one(spark, metrics.mcnemar_p(F.col("a"), F.col("b")), a=a, b=b) - many_pairs(a, b)) < 1e-8


def test_mcnemar_of_very_many_pairs(spark):
    n, gap = 2_000_000_000, 60_000
    normal = math.erfc((gap - 1) / math.sqrt(n) / math.sqrt(2))  # with continuity; exact within 1 / n here
    assert abs(one(spark, metrics.mcnemar_p(F.col("a"), F.col("b")), a=(n - gap) // 2, b=(n + gap) // 2) - normal) < 1e-8


def test_snapshot_diff_and_reconciliation(spark):
    mk = lambda rows: spark.createDataFrame(rows, "k string, v string")
    old, new = mk([("a", "1"), ("a", "1"), ("b", "1"), ("c", "1"), (None, "9")]), mk([("a", "1"), ("c", "2"), ("d", "1")])
    got = {r["k"]: r["change"] for r in diff.snapshot_diff(old, new, "k", F.col("v")).collect()}
    assert got == {"a": "UNCHANGED", "b": "REMOVED", "c": "MODIFIED", "d": "ADDED"}
    sides = {(r["k"], r["side"], r["n"]) for r in diff.pair_reconciliation(old, new, "k", "v").collect()}
    assert sides == {("a", "both", 1), ("b", "left_only", 1), ("c", "left_only", 1), ("c", "right_only", 1), ("d", "right_only", 1)}


def test_windows(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 1, None)], "k string, o int, v string")
    got = {(r["k"], r["v"], r["n_copies"]) for r in windows.keep_first(df, ["k"], ["o"], ["v"]).collect()}
    assert got == {("a", "y", 2), ("b", None, 1)}
    assert windows.balanced(df, F.col("o") == 2, "k", "s").count() == 2
    carried = windows.carried(df, "k", ["o"], F.col("v") == "y", F.col("v")).orderBy("k", "o").collect()
    assert [(r["segment"], r["carried"]) for r in carried] == [(1, "y"), (1, "x"), (0, None)]


def test_quality(spark):
    df = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", None)], "K string, v string")
    assert quality.unique(df, "u", ["K"]).first()["status"] == "FAIL" and quality.one_value(df, "o", "K", "v").first()["n_bad"] == 2
    assert quality.resolve(df, ["x", "k"]) == "K" and quality.resolve(df, ["x"]) is None
    with pytest.raises(ValueError):
        quality.require(df, ["absent"])
    assert quality.content_hash(df, ["K", "v"]).first() == quality.content_hash(df.orderBy(F.desc("v")), ["K", "v"]).first()


def test_blocks(spark):
    t = "intro 11-11-1\n98-1-12 Some (532-32-1) and 92-87-5 98-1-13 none"
    df = spark.createDataFrame([(1, t), (2, None), (3, "")], "id int, t string")
    assert {(r["code"], r["number"]) for r in blocks.designation_pairs(df, "id", "t").collect()} == {("98-1-12", "532-32-1"), ("98-1-12", "92-87-5"), ("98-1-13", None)}
    g = "Lead group\n1 lead oxide 1317-36-8\n2 lead salt 598-63-0\n3 others -\nChromium\n1 chromate 7758-97-6"
    rows = blocks.grouped_list(spark.createDataFrame([(1, g)], "id int, t string"), "id", "t").collect()
    assert [(r["grp"], r["title"], r["item"], r["number"]) for r in rows] == [(1, "Lead group", 1, "1317-36-8"), (1, "Lead group", 2, "598-63-0"), (1, "Lead group", 3, None), (2, "Chromium", 1, "7758-97-6")]


def test_sources_round_trip(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿id,name\n1,\"x, y\"\n2,\n".encode())
    df = tables.read_text_table(spark, str(tmp_path / "a.csv"), columns=["id", "name"])
    assert [tuple(r) for r in df.collect()] == [("1", "x, y"), ("2", "")]
    (tmp_path / "k.csv").write_bytes("id,name\n1,독성\n".encode("cp949"))
    assert tables.read_text_table(spark, str(tmp_path / "k.csv")).first()["name"] == "독성"
    out = str(tmp_path / "log")
    tables.append_guarded(df, out)
    tables.append_guarded(df, out)
    assert spark.read.parquet(out).count() == 4
    with pytest.raises(ValueError):
        tables.append_guarded(df.withColumn("more", F.lit(1)), out)
    walk = tables.walk_json(spark.createDataFrame([(1, '{"a": [1, {"b": null, "c": "x"}]}'), (2, "broken"), (3, None)], "id int, t string"), "id", "t")
    assert [(r["path"], r["kind"]) for r in walk.filter("kind = 'scalar'").collect()] == [("$.a[0]", "scalar"), ("$.a[1].c", "scalar")]
    empty, status = tables.optional_table(spark, str(tmp_path / "none"), df.schema)
    assert status == "INPUT_REQUIRED" and empty.count() == 0


def test_encoding_of_all_of_each_file(spark, tmp_path):
    names = lambda *files: {r["id"]: r["name"] for r in tables.read_text_table(spark, [str(tmp_path / f) for f in files]).collect()}
    plain = "id,name\n" + "".join(f"{i},substance\n" for i in range(6000))
    assert len(plain) > 70_000
    (tmp_path / "late %20.csv").write_bytes((plain + "k,독성\n").encode("cp949"))
    (tmp_path / "u.csv").write_bytes("\ufeffid,name\nu,\"염\n류 \ufffd\"\n".encode())
    (tmp_path / "k.csv").write_bytes("name,id\n물질,v\n".encode("cp949"))
    assert tables.read_text_table(spark, str(tmp_path / "late*")).filter("id = 'k'").first()["name"] == "독성"
    assert names("u.csv", "k.csv") == {"u": "염\n류 \ufffd", "v": "물질"}
    both = names("u.csv", "late %20.csv")
    assert len(both) == 6002 and both["k"] == "독성" and both["u"] == "염\n류 \ufffd"
    (tmp_path / "none.csv").write_bytes(b"id,name\n1,\xff\xff\n")
    with pytest.raises(ValueError, match="none.csv"):
        tables.read_text_table(spark, str(tmp_path / "none.csv"))
