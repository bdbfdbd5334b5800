import json

from sieveworks.operators import drift
from sieveworks.session import cut


def recs(spark, files):
    rows = [("f", s, n, p if isinstance(p, str) or p is None else json.dumps(p)) for s, lines in files.items() for n, p in enumerate(lines)]
    return drift.records(spark.createDataFrame(rows, "feed string, seq int, line int, payload string"), "payload", ["feed", "seq"], "line")


def changes(spark, files):
    return {tuple(r)[1:] for r in drift.schema_changes(recs(spark, files), "feed", "seq", "id").collect()}


def test_changes(spark):
    got = changes(
        spark,
        {
            1: [{"id": "1", "a": 1, "n": "x", "z": None}, {"id": "2", "a": 2, "n": "y"}, None, "no json", "[1]", ""],
            4: ["﻿" + json.dumps({"id": "1", "a": "1", "m": "x", "z": 5}) + "\r", {"id": "2", "a": "2", "m": "y"}, {"id": "3", "a": "3", "m": "w", "q": True}],
            5: [{"id": "1", "a": "1", "q": None}, {"id": "2", "a": None}],
        },
    )
    assert got == {(4, "renamed", "n", "m"), (4, "retyped", "a", "a"), (4, "added", "", "q"), (5, "removed", "m", ""), (5, "removed", "z", "")}


def test_rename_needs_most_values(spark):
    got = changes(spark, {1: [{"id": str(i), "n": i} for i in range(4)], 2: [{"id": str(i), "m": i if i < 2 else 99} for i in range(4)]})
    assert got == {(2, "removed", "n", ""), (2, "added", "", "m")}


def test_no_table_of_files_goes_to_the_driver(spark, monkeypatch, tmp_path):
    plans = []
    planned = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df
    monkeypatch.setattr(drift, "cut", lambda df: cut(planned(df)))
    rows = [("f", s, n, json.dumps({"id": str(n), f"n{s}": {"v": n, f"w{s}": 1}})) for s in range(1, 5) for n in range(3)]
    spark.createDataFrame(rows, "feed string, seq int, line int, payload string").write.parquet(f"{tmp_path}/t")  # files have a size to estimate from
    read = drift.parsed(spark.read.parquet(f"{tmp_path}/t"), "payload", ["feed", "seq"], "line")
    got = planned(drift.schema_changes(read, "feed", "seq", "id")).collect()
    assert {tuple(r)[1:] for r in got} == {(s, k, x, y) for s in (2, 3, 4) for k, x, y in (("removed", f"n{s - 1}", ""), ("added", "", f"n{s}"))}
    assert len(plans) == 4 and "SortMergeJoin" in "".join(plans)
    assert not any("Broadcast" in p for p in plans)


def test_one_file_and_empty(spark):
    assert changes(spark, {1: [{"id": "1"}]}) == set()
    assert drift.schema_changes(recs(spark, {1: [None]}).limit(0), "feed", "seq", "id").count() == 0


def test_consistent_table_reports_failed_casts(spark):
    v = recs(spark, {1: [{"id": "1", "n": 3}, {"id": "2", "no": "x7"}], 2: [{"id": "3", "no": "8"}]})
    t = drift.consistent_table(v, ["feed", "seq"], "line", {"id": ("string", ["id"]), "n": ("bigint", ["n", "no"])})
    assert {(r["id"], r["n"], r["failed_casts"]) for r in t.collect()} == {("1", 3, ""), ("2", None, "n"), ("3", 8, "")}


def test_nested_fields_and_sets_of_types(spark):
    got = changes(
        spark,
        {
            1: [{"id": "1", "x": {"a": 1}, "y": [1], "w": [1, "u"]}, {"id": "2", "y": ["v"]}],
            2: [{"id": "1", "x": {"a": "s", "b": 2}, "y": [1], "w": [1, "u"], "v": {"q": 1}}, {"id": "2", "y": 3}, {"id": "3", "y": "z"}],
            3: [{"id": "1", "x": 5, "y": "z", "w": [1, "u"]}],
        },
    )
    assert got == {
        (2, "retyped", "x.a", "x.a"), (2, "added", "", "x.b"), (2, "retyped", "y", "y"), (2, "added", "", "v"),
        (3, "retyped", "x", "x"), (3, "retyped", "y", "y"), (3, "removed", "v", ""),
    }


def test_schemas_with_odd_names():
    got = drift.flattened("OBJECT<`a b: c`: OBJECT<`p.q`: VOID, `x``y`: ARRAY<OBJECT<k: BIGINT>>, `z,>`: DECIMAL(2,1)>>")
    names = [(p.replace(drift.STEP, "/"), k) for p, k in got]
    assert names == [("", 16), ("/a b: c", 16), ("/a b: c/p.q", 0), ("/a b: c/x`y", 8), ("/a b: c/x`y/[]", 16), ("/a b: c/x`y/[]/k", 2), ("/a b: c/z,>", 2)]


def table(spark, files):
    v = recs(spark, files)
    columns = drift.inferred_columns(v, "feed", "seq", "id", ["feed", "seq", "line"])
    return columns, drift.consistent_table(v, ["feed", "seq"], "line", columns)


def test_columns_are_found_and_keep_every_value(spark):
    columns, t = table(
        spark,
        {
            1: [{"id": "1", "n": 3, "team": ["a"], "z": None, "seq": True}, {"id": "2", "n": "x7", "no`q": 5}, {"id": "3", "n": 4}],
            2: [{"id": "1", "Größe ": 3, "team": ["a"]}, {"id": "2", "Größe ": "x7"}, {"id": "3", "Größe ": 4}],
        },
    )
    assert columns == {"id": ("string", ["id"]), "Größe ": ("bigint", ["Größe ", "n"]), "team": ("string", ["team"]), "no`q": ("bigint", ["no`q"]), "seq_": ("boolean", ["seq"]), "z": ("string", ["z"])}
    got = {(r["seq"], r["id"]): (r["Größe "], r["team"], r["no`q"], r["seq_"], r["failed_casts"], r["rest"] and json.loads(r["rest"])) for r in t.collect()}
    assert got == {
        (1, "1"): (3, '["a"]', None, True, "", None), (1, "2"): (None, None, 5, None, "Größe ", {"n": "x7"}), (1, "3"): (4, None, None, None, "", None),
        (2, "1"): (3, '["a"]', None, None, "", None), (2, "2"): (None, None, None, None, "Größe ", {"Größe ": "x7"}), (2, "3"): (4, None, None, None, "", None),
    }


def test_names_that_meet_in_a_file_stay_apart(spark):
    columns, _ = table(spark, {1: [{"id": "1", "a": 1}], 2: [{"id": "1", "x": 1}], 3: [{"id": "1", "a": 1, "b": 1.5}], 4: [{"id": "1", "x": 1, "a": 2}]})
    assert not any({"a", "x"} <= set(names) for _, names in columns.values())


def test_rejected_lines_are_counted(spark):
    rows = [("f", 1, 1, "{}"), ("f", 1, 2, "no"), ("f", 1, 2, "no"), ("f", 1, 3, None), ("f", 1, 4, '{"a":1,"a":2}'), ("f", 2, 1, '\ufeff{"a":1}\r')]
    df = spark.createDataFrame(rows, "feed string, seq int, line int, payload string")
    assert {tuple(r) for r in drift.rejected(df, "payload", ["feed", "seq"], "line").collect()} == {("f", 1, 4, 3), ("f", 2, 1, 0)}
