"""Tables out of workbooks, zipped documents and the text of appendices.

A workbook or document is opened where it is read, one file a row; what comes
out are rows of cells or lines, and all that follows is columns. Files are read
with the standard library. Files that can't be opened give one row with the
reason. Cells are texts, missing ones ''.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from functools import reduce
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.conditions import NUMBER_PATTERN
from ..operators import windows

#: Codes, list items, catch-all items, limits and brackets of appendices.
CODE = r"^0?\d{1,3}-\d+-\d+$"
ITEM = r"^(\d{1,3})\s+(.*?)\s*(\d{2,7}-\d{2}-\d)\s*$"
CATCH_ALL = r"^(\d{1,3})\s+(.+?)\s*-?\s*$"
LIMIT = r"(\d+(?:\.\d+)?)\s*%\s*(이\s*상|초\s*과|이\s*하|미\s*만)"
WIDE_CODE = r"(?<!\d)(\d{2,4}-\d+-\d+(?:\s*(?:의\s*소번호|소번호)\s*\d+)?)(?!\d)"
ENTRY_END = r"및\s*이\s*를\s*(\d+(?:\.\d+)?)\s*%\s*(이상|초과|이하|미만)\s*함\s*유\s*한\s*혼\s*합\s*물(?:\s*질)?"
BRACKET = r"\[(.+?)\]"

_NAME = re.compile(r"\{[^}]*\}")


def _local(e: ElementTree.Element) -> str:
    return _NAME.sub("", e.tag)


def _sheets(data: bytes) -> Iterator[tuple[str, int, list[str]]]:
    """(sheet, row number, cells) of a workbook."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter() if _local(t) == "t") for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if _local(si) == "si"]
        links = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter():
            if _local(s) != "sheet":
                continue
            rid = next((v for k, v in s.attrib.items() if _NAME.sub("", k) == "id"), "")
            path = links.get(rid, "").lstrip("/")
            path = path if path.startswith("xl/") else f"xl/{path}"
            if path not in names:
                continue
            for n, row in enumerate((r for r in ElementTree.fromstring(z.read(path)).iter() if _local(r) == "row"), 1):
                cells: dict[int, str] = {}
                for k, c in enumerate(x for x in row if _local(x) == "c"):
                    ref = re.match(r"[A-Z]+", c.get("r", ""))
                    at = reduce(lambda a, ch: a * 26 + ord(ch) - 64, ref.group(), 0) - 1 if ref else k
                    value = "".join(t.text or "" for t in c.iter() if _local(t) in ("v", "t"))
                    cells[at] = shared[int(value)] if c.get("t") == "s" and value.isdigit() else value
                yield s.get("name", ""), int(row.get("r", n)), [cells.get(i, "") for i in range(max(cells, default=-1) + 1)]


def _paragraphs(data: bytes) -> Iterator[tuple[str, int, list[str]]]:
    """(section, number, cells) of a zipped document: paragraphs as one cell, table rows as theirs."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for path in sorted(n for n in z.namelist() if re.search(r"section\d+\.xml$|document\.xml$", n)):
            n = 0
            stack = [ElementTree.fromstring(z.read(path))]
            words = lambda e: "".join(t.text or "" for t in e.iter() if _local(t) == "t").strip()
            while stack:
                e = stack.pop()
                if _local(e) == "tr":
                    n += 1
                    yield path, n, [words(c) for c in e if _local(c) in ("tc", "c")]
                elif _local(e) == "p" and not any(_local(x) == "tr" for x in e.iter()):
                    if words(e):
                        n += 1
                        yield path, n, [words(e)]
                else:
                    stack += reversed(list(e))


_READERS = {"xlsx": _sheets, "xlsm": _sheets, "hwpx": _paragraphs, "docx": _paragraphs}


def read_grid(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(file, sheet, row_no, cells, problem) of workbooks and zipped documents, chosen by suffix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, data in zip(b.column(0).to_pylist(), b.column(1)):
                rows: list[tuple] = []
                try:
                    reader = _READERS[file.rsplit(".", 1)[-1].lower()]
                    rows = [(s, n, c, None) for s, n, c in reader(data.as_py())]
                except Exception as e:
                    rows = [("", 0, [], f"{type(e).__name__}: {e}"[:200])]
                cols = list(zip(*rows)) if rows else [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(rows), pa.string()), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.list_(pa.string())), pa.array(cols[3], pa.string())], ["file", "sheet", "row_no", "cells", "problem"])

    files = spark.read.format("binaryFile").load(path if isinstance(path, str) else list(path))
    return files.select("path", "content").mapInArrow(run, "file string, sheet string, row_no int, cells array<string>, problem string")


def sheet_rows(grid: DataFrame, by: Sequence[str], header: Sequence[str], columns: Sequence[str], carry: str, footer: str, within: int = 20) -> DataFrame:
    """(by.., row_no, columns.., deleted): the data rows of official sheets.

    The header is the first of the first rows whose cells hold all header
    words; what is above it, and rows that begin as the footer does, are no
    data. ``carry`` is filled on from the row above. A row whose cells say only
    that it is deleted is flagged.
    """
    joined = F.array_join("cells", "|")
    is_header = reduce(lambda a, b: a & b, [F.contains(joined, F.lit(w)) for w in header])
    head = grid.filter((F.col("row_no") <= within) & is_header).groupBy(*by).agg(F.min("row_no").alias("_head"))
    cell = lambda i: F.trim(F.coalesce(F.get("cells", F.lit(i)), F.lit("")))
    rows = grid.join(head, list(by)).filter((F.col("row_no") > F.col("_head")) & (F.trim(F.regexp_replace(joined, r"\|", "")) != "") & ~F.coalesce(cell(0), F.lit("")).rlike(footer))
    named = rows.select(*by, "row_no", *[cell(i).alias(c) for i, c in enumerate(columns)], F.regexp_replace(joined, r"[|\s<>]", "").alias("_all"))
    w = Window.partitionBy(*by).orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)  # a sheet's rows
    kept = F.coalesce(F.last(F.when(F.col(carry) != "", F.col(carry)), ignorenulls=True).over(w), F.lit(""))
    return named.withColumn(carry, kept).withColumn("deleted", F.col("_all").rlike(r"^[\d-]*삭제$")).drop("_all")


def lines(df: DataFrame, record_id: str, column: str) -> DataFrame:
    """(record_id, line_no, line): trimmed lines that aren't blank."""
    x = df.select(F.col(record_id).alias("record_id"), F.posexplode(F.split(F.coalesce(F.col(column).cast("string"), F.lit("")), r"\r\n|\r|\n")).alias("line_no", "line"))
    return x.withColumn("line", F.trim("line")).filter("line <> ''")


def grouped_appendix(df: DataFrame, record_id: str, column: str) -> DataFrame:
    """(record_id, grp, code, inferred, title, item_no, name, number, catch_all, limit_pct, limit_word) of numbered lists.

    A list begins where an item's number doesn't rise. Numbered lines without a
    registry number right after a list's last item, with what they run on to,
    are its catch-all items; the lines after these are the next list's title,
    with its code and limit. Windows run within a text.
    """
    x = lines(df, record_id, column)
    by_line = lambda p: Window.partitionBy(*p).orderBy("line_no")
    item = F.when(F.col("line").rlike(ITEM), F.regexp_extract("line", ITEM, 1).cast("int"))
    x = x.withColumns({"item": item, "is_code": F.col("line").rlike(CODE)})
    x = x.withColumn("_before", F.last("item", ignorenulls=True).over(by_line(["record_id"]).rowsBetween(Window.unboundedPreceding, -1)))
    x = x.withColumn("grp", F.sum(F.when(F.col("item").isNotNull() & (F.col("_before").isNull() | (F.col("item") <= F.col("_before"))), 1).otherwise(0)).over(by_line(["record_id"])))
    x = x.withColumn("_last", F.max(F.when(F.col("item").isNotNull(), F.col("line_no"))).over(Window.partitionBy("record_id", "grp")))
    # behind the last item: numbered lines begin catch-alls, and are complete at a dash or a closing word
    ends = r"-$|혼합물$|제외한다\.$"
    tail = (F.col("line_no") > F.col("_last")) & ~F.col("is_code")
    starts = tail & F.col("item").isNull() & F.col("line").rlike(CATCH_ALL)
    x = x.withColumns({"_tail": tail, "_starts": starts})
    up = by_line(["record_id", "grp"])
    done = F.lag(F.when(F.col("_tail"), F.col("line").rlike(ends)), 1).over(up)
    x = x.withColumn("_stops", F.col("_tail") & ~F.col("_starts") & F.coalesce(done, F.lit(True)))
    x = x.withColumn("_title", F.col("_tail") & (F.sum(F.when(F.col("_stops"), 1).otherwise(0)).over(up) > 0))
    x = x.withColumn("_more", F.sum(F.when(F.col("_starts") & ~F.col("_title"), 1).otherwise(0)).over(up))
    # a list's title stands before it: what is left of the list before, or the text's beginning
    own = F.col("_title") | (F.col("grp") == 0)
    titles = x.filter(own & ~F.col("is_code")).groupBy("record_id", (F.col("grp") + 1).alias("grp")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda r: r["line"]), " ").alias("title"))
    before = x.filter(F.col("is_code") & ((F.col("line_no") > F.col("_last")) | (F.col("grp") == 0))).groupBy("record_id", (F.col("grp") + 1).alias("grp")).agg(F.min_by("line", "line_no").alias("c0"))
    inside = x.filter(F.col("is_code") & (F.col("line_no") < F.col("_last"))).groupBy("record_id", "grp").agg(F.min_by("line", "line_no").alias("c1"))
    listed = x.filter("item is not null").select("record_id", "grp", "line_no", F.col("item").alias("item_no"), F.regexp_extract("line", ITEM, 2).alias("name"), F.regexp_extract("line", ITEM, 3).alias("number"), F.lit(False).alias("catch_all"))
    caught = x.filter(F.col("_tail") & ~F.col("_title") & (F.col("_more") > 0) & (F.col("grp") > 0)).groupBy("record_id", "grp", "_more").agg(F.min("line_no").alias("line_no"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda r: r["line"]), " ").alias("_t"))
    caught = caught.select("record_id", "grp", "line_no", F.regexp_extract("_t", CATCH_ALL, 1).cast("int").alias("item_no"), F.regexp_extract("_t", CATCH_ALL, 2).alias("name"), F.lit("").alias("number"), F.lit(True).alias("catch_all"))
    out = listed.unionByName(caught).join(titles, ["record_id", "grp"], "left").join(before, ["record_id", "grp"], "left").join(inside, ["record_id", "grp"], "left")
    title, code = F.coalesce("title", F.lit("")), F.coalesce("c0", "c1")
    return out.select(
        "record_id", F.col("grp").cast("int").alias("grp"), F.coalesce(code, F.concat(F.lit("UNKNOWN-"), F.col("grp").cast("string"))).alias("code"), code.isNull().alias("inferred"), title.alias("title"), "item_no", "name", "number", "catch_all",
        F.regexp_extract(title, LIMIT, 1).try_cast("double").alias("limit_pct"), F.regexp_replace(F.regexp_extract(title, LIMIT, 2), r"\s", "").alias("limit_word"),
    )


def flat_list(df: DataFrame, record_id: str, column: str) -> DataFrame:
    """(record_id, entry, name, number, limit_pct, limit_word): entries of running text that end at their limit, one row per number."""
    marked = F.regexp_replace(F.coalesce(F.col(column).cast("string"), F.lit("")), f"({ENTRY_END})", "$1\u0001")
    x = df.select(F.col(record_id).alias("record_id"), F.posexplode(F.split(marked, "\u0001")).alias("entry", "_t")).filter(F.col("_t").rlike(ENTRY_END))
    name = F.coalesce(F.nullif(F.regexp_extract("_t", BRACKET, 1), F.lit("")), F.trim(F.regexp_extract("_t", rf"(?s)^(.*?)(?:{NUMBER_PATTERN}|{ENTRY_END})", 1)))
    numbers = F.array_distinct(F.regexp_extract_all("_t", F.lit(NUMBER_PATTERN), F.lit(1)))
    return x.select("record_id", "entry", F.trim(F.regexp_replace(name, r"[\s,(]+$", "")).alias("name"), F.explode_outer(numbers).alias("number"), F.regexp_extract("_t", ENTRY_END, 1).cast("double").alias("limit_pct"), F.regexp_extract("_t", ENTRY_END, 2).alias("limit_word"))


def wide_rows(df: DataFrame, record_id: str, column: str) -> DataFrame:
    """(record_id, line_no, code, numbers): lines of a wide table that carry a code."""
    x = lines(df, record_id, column).filter(F.col("line").rlike(WIDE_CODE))
    return x.select("record_id", "line_no", F.regexp_replace(F.regexp_extract("line", WIDE_CODE, 1), r"\s", "").alias("code"), F.array_distinct(F.regexp_extract_all("line", F.lit(NUMBER_PATTERN), F.lit(1))).alias("numbers"))


def appendix_kind(c: Column, stub: str, hints: Sequence[str]) -> Column:
    """Which grammar an appendix's text is read by, the first that fits: STUB, WIDE, GROUPED, FLAT or NONE."""
    t = F.coalesce(c.cast("string"), F.lit(""))
    hinted = reduce(lambda a, b: a | b, [F.contains(F.regexp_replace(t, r"\s", ""), F.lit(h)) for h in hints])
    return (
        F.when(t.rlike(f"(?is){stub}"), "STUB")
        .when(hinted & t.rlike(WIDE_CODE), "WIDE")
        .when(t.rlike(f"(?m){ITEM}"), "GROUPED")
        .when(t.rlike(ENTRY_END), "FLAT")
        .otherwise("NONE")
    )


def rules_in_rows(df: DataFrame, record_id: str, cells: Sequence[str], by: str, order: Sequence[str], category: Column) -> DataFrame:
    """(record_id, numbers, category, text): rows whose cells hold a registry number, each with the last category its part named."""
    text = F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cells])
    rows = df.select(F.col(record_id).alias("record_id"), by, *order, text.alias("text"), category.alias("_c"))
    out = windows.carried(rows, by, order, F.col("_c").isNotNull(), F.col("_c"))
    return out.filter(F.col("text").rlike(NUMBER_PATTERN)).select("record_id", F.array_distinct(F.regexp_extract_all("text", F.lit(NUMBER_PATTERN), F.lit(1))).alias("numbers"), F.coalesce("carried", F.lit("")).alias("category"), "text")
