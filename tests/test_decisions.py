import io
import zipfile

import pytest
from pyspark.sql import functions as F
from sieveworks.functions import answers, rules, scope
from sieveworks.operators import gates
from sieveworks.operators import governance as G
from sieveworks.sources import grids, tables


def classes(spark, rows):
    df = spark.createDataFrame(rows, "source string, name string, has boolean")
    return [(r["s"]["scope"], r["s"]["positive"], r["s"]["reasons"], r["s"]["evidence"]) for r in df.select(scope.classified(F.col("source"), F.col("name"), F.col("has")).alias("s")).collect()]


def test_scope_classes(spark):
    got = classes(
        spark,
        [
            ("A-acid and  its salts", "", True), ("납과 그 화합물", "", True), ("A salts / 구체적 목록 A sodium", "", True), ("A compounds / 구체적목록 A  다만 제외", "", True),
            ("A compounds / 구체적 목록 x", "", True), ("magnesium salt (1:1)", "X", True), ("", "reaction products of A", False), (None, None, False), (None, None, True), ("C8-10 alkyl", "", False), ("A and its derivatives", "", True),
        ],
    )
    assert [(a, b, d) for a, b, _, d in got] == [
        ("BROAD_SALT", True, "and its salts"), ("COMPOUND_GROUP", True, "과 그 화합물"), ("BROAD_SALT", True, "salts"), ("EXPLICIT_EXCEPTION", True, "다만"),
        ("COMPOUND_GROUP", True, "compounds"), ("DIRECT_CAS_ONLY", False, ""), ("REACTION_PRODUCT", True, "reaction product"), ("NO_DIRECT_CAS_OTHER", True, ""), ("DIRECT_CAS_ONLY", False, ""), ("STRUCTURAL_RANGE", True, "C8-10"), ("DERIVATIVE_FAMILY", True, "and its derivatives"),
    ]
    assert got[5][2] == "DIRECT_CAS_ASSIGNED_AND_NO_EXPLICIT_SCOPE_EXTENSION;SALT_WORD_IN_SPECIFIC_NAME" and got[6][2] == "NO_DIRECT_CAS;NO_DIRECT_CAS_REACTION_PRODUCT"


@pytest.mark.parametrize(
    "text, want",
    [('{"a": {"b": 1}} tail {"c": 2}', '{"a": {"b": 1}}'), ('<think>{"x": 1}</think>```json\n{"y": "}"}\n```', '{"y": "}"}'), ("{bad {\"k\": 1}", '{"k": 1}'), ("none", None), (None, None), ("[1, 2]", None), ("{" * 3000, None)],
)
def test_first_object(text, want):
    assert answers._first(text) == want


def test_labels_of_notices_and_targets(spark):
    df = spark.createDataFrame([("제2027-03호", "2026.1.1"), ("공고 12", "20250401"), ("x", None), (None, None)], "n string, d string")
    assert [r[0] for r in df.select(rules.notice_label(F.col("n"), F.col("d"))).collect()] == ["2027-3", "2025-12", "", ""]
    keys = spark.createDataFrame([("2027-3",), ("2026-11",), (None,)], "l string").orderBy(rules.notice_key(F.col("l")).desc()).collect()
    assert [r[0] for r in keys] == ["2027-3", "2026-11", None]
    t = spark.createDataFrame([(" a  b ", ["A b", "c"])], "t string, x array<string>")
    assert t.select(rules.title_matches(F.col("t"), "AB", [])).first()[0] and t.select(rules.title_matches(F.col("t"), "z", ["A", "b"])).first()[0] and not t.select(rules.title_matches(F.col("t"), "z", [])).first()[0]


@pytest.mark.parametrize("text, want", [("3. | Benzidine CAS No. 92-87-5", "Benzidine"), ("고시 | 1.2 | name, salt | 50-00-0", "name, salt"), ("12 | --- | 50-00-0", ""), (None, "")])
def test_guessed_names(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(rules.guessed_name(F.col("t"))).first()[0] == want


@pytest.mark.parametrize("s, n", [("Cc1ccccc1", 7), ("C(C)ClO[Na+]", 2), ("[13C]C[Cu]", 2), ("", None), ("[cH]1ccccc1", 6)])
def test_carbon_count(spark, s, n):
    assert spark.createDataFrame([(s,)], "s string").select(rules.carbon_count(F.col("s"))).first()[0] == n


def test_retrieval_gate_without_structures_and_with_ties(spark):
    q = spark.createDataFrame([("a", ["2", "1"]), ("b", ["1", "3"]), ("c", ["1"]), ("d", ["9"]), ("e", []), ("f", None), ("g", ["8"])], "query_id string, numbers array<string>")
    c = spark.createDataFrame([("X", "components", ["1", "2", "2"]), ("Y", "components", ["1", "3"]), ("Z", "components", ["3", "1"]), ("X", "member", ["1"]), ("Y", "member", ["9"]), ("Z", "member", ["9"])], "target_id string, kind string, numbers array<string>")
    got = {r["query_id"]: (r["gate_status"], r["gate_target_id"]) for r in gates.retrieval_gate(q, c).collect()}
    assert got == {"a": ("FOUND", "X"), "b": ("REVIEW", ""), "c": ("FOUND", "X"), "d": ("REVIEW", ""), "e": ("REVIEW", ""), "f": ("REVIEW", ""), "g": ("REVIEW", "")}


def test_verify_raises(spark):
    a = G.frozen(spark.range(3), "t", ["id"])
    assert G.verify(a, a) is a
    with pytest.raises(ValueError, match="t: CHANGED"):
        G.verify(a, G.frozen(spark.range(4), "t", ["id"]))


def test_challenge_sample_when_challenges_abound(spark):
    df = spark.range(300).selectExpr("cast(id as string) as id", "id % 3 as s", "id < 200 as hard")
    got = G.challenge_sample(df, F.col("hard"), "s", "id", "x", 20).collect()
    assert len(got) == 20 and all(int(r["id"]) < 200 for r in got) and {r["reason"] for r in got} == {"STRATUM_0", "STRATUM_1", "STRATUM_2", "FILL"}
    assert G.challenge_sample(df, F.col("hard"), "s", "id", "x", 400).count() == 300 and G.challenge_sample(df.limit(0), F.col("hard"), "s", "id", "x", 4).count() == 0


APPENDIX = """머리말 0.1% 이상
98-1-1
1 alpha 50-00-0
2 beta salt 64-17-5
3 기타 물질
및 이를 함유한 혼합물
Second group 5 % 초과
1 gamma 7732-18-5
2 rest -
3 more -
Third
1 delta 71-43-2"""


def test_grouped_appendix(spark):
    df = spark.createDataFrame([("d", APPENDIX), ("e", None), ("f", "no list")], "id string, t string")
    got = [(r["grp"], r["code"], r["item_no"], r["name"], r["number"], r["catch_all"], r["limit_pct"], r["limit_word"]) for r in grids.grouped_appendix(df, "id", "t").orderBy("grp", "item_no").collect()]
    assert got == [
        (1, "98-1-1", 1, "alpha", "50-00-0", False, 0.1, "이상"), (1, "98-1-1", 2, "beta salt", "64-17-5", False, 0.1, "이상"), (1, "98-1-1", 3, "기타 물질 및 이를 함유한 혼합물", "", True, 0.1, "이상"),
        (2, "UNKNOWN-2", 1, "gamma", "7732-18-5", False, 5.0, "초과"), (2, "UNKNOWN-2", 2, "rest", "", True, 5.0, "초과"), (2, "UNKNOWN-2", 3, "more", "", True, 5.0, "초과"),
        (3, "UNKNOWN-3", 1, "delta", "71-43-2", False, None, ""),
    ]


def test_flat_and_wide_lists(spark):
    text = "acid [A, B] 50-00-0, 64-17-5 및 이를 0.1% 이상 함유한 혼합물 beta 71-43-2 및 이를 25 % 초과 함유한 혼합물"
    df = spark.createDataFrame([("d", text)], "id string, t string")
    got = [(r["entry"], r["name"], r["number"], r["limit_pct"], r["limit_word"]) for r in grids.flat_list(df, "id", "t").orderBy("entry", "number").collect()]
    assert got == [(0, "A, B", "50-00-0", 0.1, "이상"), (0, "A, B", "64-17-5", 0.1, "이상"), (1, "beta", "71-43-2", 25.0, "초과")]
    kinds = spark.createDataFrame([("자세한 내용은 상단 메뉴",), ("생태 유해성 물질\n98-1-1 x 50-00-0",), (APPENDIX,), (text,), (None,)], "t string")
    assert [r[0] for r in kinds.select(grids.appendix_kind(F.col("t"), "자세한\\s*내용은.*?상단\\s*메뉴", ["생태유해성물질"])).collect()] == ["STUB", "WIDE", "GROUPED", "FLAT", "NONE"]
    wide = grids.wide_rows(spark.createDataFrame([("d", "98-1-1 소번호 2 x 50-00-0\nnone")], "id string, t string"), "id", "t").collect()
    assert [(r["code"], r["numbers"]) for r in wide] == [("98-1-1소번호2", ["50-00-0"])]


def workbook():
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    cell = lambda ref, v: f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
    rows = [["title"], ["code", "name", "CAS"], ["98-1-1", "alpha", "50-00-0"], ["", "beta", "64-17-5"], ["98-1-2", "삭제", ""], ["비고: end"]]
    sheet = "".join(f'<row r="{i}">{"".join(cell("ABC"[k] + str(i), v) for k, v in enumerate(r) if v)}</row>' for i, r in enumerate(rows, 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="S1" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{sheet}</sheetData></worksheet>")
    return out.getvalue()


def test_workbooks_and_documents(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook())
    (tmp_path / "b.xlsx").write_bytes(b"no zip")
    with zipfile.ZipFile(tmp_path / "c.hwpx", "w") as z:
        z.writestr("Contents/section0.xml", "<s><p><run><t>Hello </t><t>there</t></run></p><p><tbl><tr><tc><p><t>x</t></p></tc><tc><p><t>y</t></p></tc></tr></tbl></p></s>")
    grid = tables.read_any(spark, f"{tmp_path}/*.xlsx")
    assert grid.filter("problem is not null").count() == 1
    got = grids.sheet_rows(grid, ["file", "sheet"], ["code", "CAS"], ["code", "name", "cas"], "code", "^비고").orderBy("row_no").collect()
    assert [(r["code"], r["name"], r["cas"], r["deleted"]) for r in got] == [("98-1-1", "alpha", "50-00-0", False), ("98-1-1", "beta", "64-17-5", False), ("98-1-2", "삭제", "", True)]
    assert [r["cells"] for r in grids.read_grid(spark, f"{tmp_path}/c.hwpx").orderBy("row_no").collect()] == [["Hello there"], ["x", "y"]]


def test_wrapped_files_bundles_and_marks(spark, tmp_path):
    (tmp_path / "w.csv").write_text('export of today\n"a","b"\n1,"x, y"\n2,\n', encoding="utf-8")
    assert [tuple(r) for r in tables.read_wrapped(spark, f"{tmp_path}/w.csv", ["a", "b"]).collect()] == [("1", "x, y"), ("2", "")]
    long = "n" * 40
    got = tables.write_bundle({long: spark.range(2), long + "x": spark.range(3)}, f"{tmp_path}/bundle")
    assert sorted(map(len, got)) == [31, 31] and sorted(spark.read.parquet(p).count() for p in got.values()) == [2, 3]
    tables.write_csv(spark.range(1), f"{tmp_path}/out")
    assert next((tmp_path / "out").glob("*.csv")).read_bytes().startswith(b"\xef\xbb\xbfid")
    r = tables.registry_table(spark, {"G": ["1", "2"], "H": ["1"]})
    assert {(x["number"], x["groups"]) for x in tables.inverted(r, "rule_id", "number").collect()} == {("1", "G;H"), ("2", "G")}
