import datetime as dt

from sieveworks.operators import orphans as O

T = lambda d: dt.datetime(2027, 1, d)
REF = "id string, a string, b string, at timestamp, target string"


def refs(spark, rows, keys=("a",)):
    return O.references(spark.createDataFrame(rows, REF), "t", "id", "k", list(keys), "at")


def known(spark, rows, keys=("a",)):
    return O.targets(spark.createDataFrame(rows, "a string, b string, at timestamp, gone timestamp"), "k", list(keys), "at", "gone")


def result(df):
    return {(r["record_id"], r["reason"]) for r in df.collect()}


def test_reasons(spark):
    r = refs(spark, [("1", " X ", None, T(5), ""), ("2", "y", None, T(5), ""), ("3", "z", None, T(5), ""), ("4", None, None, T(5), ""), ("5", "  ", None, T(5), ""), ("6", "w", None, T(5), ""), ("7", "v", None, T(5), "")])
    k = known(spark, [("x", None, T(1), None), ("Y", None, T(9), None), ("w", None, T(1), T(5)), ("v", None, T(1), T(6))])
    assert result(O.find_orphans(r, k)) == {("2", "late"), ("3", "missing"), ("6", "deleted")}


def test_first_delivery_counts(spark):
    r = refs(spark, [("1", "x", None, T(3), ""), ("1", "x", None, T(9), ""), ("2", "y", None, T(3), ""), ("2", "y", None, T(9), "")])
    k = known(spark, [("x", None, T(1), T(5)), ("y", None, T(6), None)])
    assert result(O.find_orphans(r, k)) == {("2", "late")}


def test_composite_keys_by_null_mask(spark):
    rows = [("1", "x", "p", T(5), ""), ("2", "x", None, T(5), ""), ("3", None, "q", T(5), ""), ("4", "x", "q", T(5), ""), ("5", None, None, T(5), "")]
    k = known(spark, [("x", "p", T(1), None), ("u", "r", T(1), None)], ("a", "b"))
    r = refs(spark, rows, ("a", "b"))
    assert result(O.find_orphans(r, k, 2, "simple")) == {("4", "missing")}
    assert result(O.find_orphans(r, k, 2, "partial")) == {("3", "missing"), ("4", "missing")}
    assert result(O.find_orphans(r, k, 2, "full")) == {("2", "missing"), ("3", "missing"), ("4", "missing")}


def test_partial_keys_meet_many_targets_along_time(spark):
    k = known(spark, [("a", "1", T(1), T(2)), ("a", "2", T(3), None), ("b", "1", T(1), T(4)), ("b", "2", T(2), T(3)), ("c", "1", T(8), None), ("d", "1", T(6), T(5))], ("a", "b"))
    rows = [("1", "a", None, T(5), ""), ("2", "a", None, T(2), ""), ("3", "b", None, T(3), ""), ("4", "b", None, T(4), ""), ("5", "c", None, T(5), ""), ("6", "x", None, T(5), ""), ("7", None, "2", T(2), ""), ("8", "d", None, T(7), ""), ("9", "b", None, T(1), "")]
    assert result(O.find_orphans(refs(spark, rows, ("a", "b")), k, 2, "partial")) == {("2", "deleted"), ("4", "deleted"), ("5", "late"), ("6", "missing"), ("8", "deleted")}


def test_hot_keys_in_parts(spark):
    rows = [(str(i), "x" if i % 3 else "y", None, T(5), "") for i in range(300)]
    k = known(spark, [("x", None, T(1), T(2)), ("y", None, T(1), None)])
    got = result(O.find_orphans(refs(spark, rows), k, hot=7))
    assert got == {(str(i), "deleted") for i in range(300) if i % 3}


def test_mere_deletions_are_no_keys_and_empty_tables(spark):
    r = refs(spark, [("1", "x", None, T(5), "")])
    gone = O.targets(spark.createDataFrame([("x", T(1))], "a string, gone timestamp"), "k", ["a"], None, "gone")
    assert result(O.find_orphans(r, gone)) == {("1", "missing")}
    assert result(O.find_orphans(r.limit(0), gone)) == set()


def test_hot_key_and_counts(spark):
    r = refs(spark, [(str(i), "hot", None, T(5), "") for i in range(500)])
    found = O.find_orphans(r, known(spark, [("x", None, T(1), None)]))
    rows = O.orphan_counts(found).collect()
    assert [(x["table_name"], x["month"], x["reason"], x["n"]) for x in rows] == [("t", "2027-01", "missing", 500)]
