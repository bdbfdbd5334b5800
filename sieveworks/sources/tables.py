"""Tables from files, and back: delimited text, seed files, JSON trees, guarded appends.

Readers take a path or several and keep every column as text unless a schema is
given; typing is a projection of its own. Schemas, and the encoding of the whole
of each text file where it isn't given, are looked at before a job starts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.quality import require, resolve

#: Encodings tried in this order, and their names in the reader.
ENCODINGS = ("utf-8", "cp949")
_READER = {"cp949": "MS949"}


def encodings(spark: SparkSession, path: str | Sequence[str]) -> dict[str, list[str]]:
    """Encoding -> files: for each file the first encoding that decodes all of it; an error where none does.

    Lines are checked as bytes where they are read; the driver receives one row
    per file. Empty files are in no list.
    """

    def fails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bad = {}
            for file, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if file in bad and all(bad[file]):
                    continue
                bad.setdefault(file, [False] * len(ENCODINGS))
                for i, name in enumerate(ENCODINGS):
                    try:
                        line.decode(name)
                    except UnicodeDecodeError:
                        bad[file][i] = True
            yield pa.RecordBatch.from_arrays([pa.array(list(bad), pa.string()), pa.array(list(bad.values()), pa.list_(pa.bool_()))], ["file", "bad"])

    lines = spark.read.text(path if isinstance(path, str) else list(path)).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line"))
    each = lines.mapInArrow(fails, "file string, bad array<boolean>").groupBy("file").agg(*[F.bool_or(F.col("bad")[i]).alias(name) for i, name in enumerate(ENCODINGS)])
    found: dict[str, list[str]] = {}
    for row in each.orderBy("file").collect():
        name = next((n for n in ENCODINGS if not row[n]), None)
        if name is None:
            raise ValueError(f"{unquote(row['file'])} is in none of {', '.join(ENCODINGS)}")
        found.setdefault(name, []).append(unquote(row["file"]))
    return found


def read_text_table(spark: SparkSession, path: str | Sequence[str], encoding: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """A delimited file with a header, all columns text, missing ones ''; the byte order mark is dropped.

    Several files may be in different encodings, then their columns go by name.
    """
    every = path if isinstance(path, str) else list(path)
    found = {encoding: every} if encoding else encodings(spark, path)
    if len(found) < 2:
        found = {next(iter(found), ENCODINGS[0]): every}
    df = reduce(DataFrame.unionByName, [_read(spark, files, name) for name, files in found.items()])
    if columns is not None:
        require(df, columns)
        df = df.select(*columns)
    return df.fillna("")


def _read(spark: SparkSession, path: str | list[str], encoding: str) -> DataFrame:
    if encoding in _READER:  # the reader takes other than Unicode encodings only under this setting
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", _READER.get(encoding, encoding)).csv(path)
    return df.toDF(*[c.lstrip("\ufeff").strip() for c in df.columns])


def read_seed_files(spark: SparkSession, path: str) -> DataFrame:
    """All files of a pattern on end, with the name of each row's file."""
    df = spark.read.option("header", True).csv(path)
    return df.withColumn("seed_file", F.col("_metadata.file_name"))


def optional_table(spark: SparkSession, path: str | None, schema: T.StructType) -> tuple[DataFrame, str]:
    """(table, status): an empty table of the schema and INPUT_REQUIRED where the input isn't there."""
    if path is not None:
        try:
            return spark.read.schema(schema).parquet(path), "LOADED"
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return spark.createDataFrame([], schema), "INPUT_REQUIRED"


def with_aliases(df: DataFrame, aliases: dict[str, Sequence[str]]) -> DataFrame:
    """The named columns, each from the first of its candidates that is there; null where none is."""
    found = {name: resolve(df, [name, *others]) for name, others in aliases.items()}
    return df.select(*[(F.col(f"`{c}`") if c else F.lit(None).cast("string")).alias(name) for name, c in found.items()])


def _walk(node, path: str, out: list[tuple[str, str, str]]) -> str:
    """Adds a tree's objects and scalars depth first, and gives its JSON text; each text is put together from those below it once."""
    if isinstance(node, dict):
        at = len(out)
        out.append((path, "object", ""))
        below = {k: _walk(v, f"{path}.{k}", out) for k, v in node.items()}
        text = "{" + ", ".join(f"{json.dumps(k, ensure_ascii=False)}: {below[k]}" for k in sorted(below)) + "}"
        out[at] = (path, "object", text)
        return text
    if isinstance(node, list):
        return "[" + ", ".join(_walk(v, f"{path}[{i}]", out) for i, v in enumerate(node)) + "]"
    text = json.dumps(node, ensure_ascii=False)
    if node is not None:
        out.append((path, "scalar", node if isinstance(node, str) else text))
    return text


def walk_json(df: DataFrame, record_id: str, column: str) -> DataFrame:
    """(record_id, ord, path, kind, value): depth-first walk of JSON trees, objects and scalars; null and broken ones give nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows = [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    tree = json.loads((text or "").strip().lstrip("\ufeff"))
                except ValueError:
                    continue
                found: list[tuple[str, str, str]] = []
                _walk(tree, "$", found)
                ids += [i] * len(found)
                rows += [(n, *x) for n, x in enumerate(found)]
            cols = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.string()) for c in cols[1:])], ["record_id", "ord", "path", "kind", "value"])

    kind = df.schema[record_id].dataType.simpleString()
    return df.select(df[record_id].alias("record_id"), df[column].cast("string")).mapInArrow(run, f"record_id {kind}, ord int, path string, kind string, value string")


def append_guarded(df: DataFrame, path: str) -> None:
    """Append to a table only if its columns and types are those of df."""
    spark = df.sparkSession
    try:
        there = spark.read.parquet(path).schema
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        there = None
    if there is not None and [(f.name, f.dataType) for f in there] != [(f.name, f.dataType) for f in df.schema]:
        raise ValueError(f"columns differ: {there.simpleString()} and {df.schema.simpleString()}")
    df.write.mode("append").parquet(path)


def split_columns(df: DataFrame, shown: Sequence[str], held: Sequence[str], key: str) -> tuple[DataFrame, DataFrame]:
    """Two projections of a table that share only the key: what a system may see, and the answers."""
    if set(shown) & set(held) - {key}:
        raise ValueError("a column is on both sides")
    return require(df, shown).select(*shown), require(df, held).select(key, *[c for c in held if c != key])


def write_csv(df: DataFrame, path: str) -> None:
    """Delimited files in UTF-8, each with a byte order mark and a header."""
    first, *rest = df.columns
    df.toDF("\ufeff" + first, *rest).write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """A table by its suffix: parquet, JSON lines, delimited text, or the cells of workbooks and zipped documents."""
    from . import grids

    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind in ("json", "jsonl"):
        return spark.read.json(path)
    if kind in ("csv", "txt", "tsv"):
        return read_text_table(spark, path)
    if kind in ("xlsx", "xlsm", "hwpx", "docx"):
        return grids.read_grid(spark, path)
    raise ValueError(f"no reader for {path}")


def first_input(spark: SparkSession, candidates: Sequence[str], schema: T.StructType) -> tuple[DataFrame, str]:
    """``optional_table`` of the first candidate that is there."""
    for path in candidates:
        df, status = optional_table(spark, path, schema)
        if status == "LOADED":
            return df, status
    return optional_table(spark, None, schema)


def read_wrapped(spark: SparkSession, path: str, header: Sequence[str]) -> DataFrame:
    """A delimited file whose header may stand below other lines; all columns text, missing ones ''.

    The lines above it are told by the header's words and dropped by their
    order in the file, wherever its pieces are read.
    """
    lines = spark.read.text(path)
    head = lines.filter(F.split(F.regexp_replace("value", "^\ufeff|\"", ""), ",") == F.array(*[F.lit(h) for h in header]))
    if head.isEmpty():
        raise ValueError(f"no header {list(header)} in {path}")
    schema = T.StructType([T.StructField(h, T.StringType()) for h in header])
    rows = spark.read.option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE").schema(schema).csv(path)
    at = rows.withColumn("_n", F.monotonically_increasing_id())  # a multi-line file is read in one piece, in order
    first = at.filter(F.regexp_replace(F.col(header[0]), "^\ufeff", "") == header[0]).agg(F.min("_n").alias("_first"))
    return at.crossJoin(F.broadcast(first)).filter("_n > _first").select(*header).fillna("")


def write_bundle(tables: dict[str, DataFrame], path: str) -> dict[str, str]:
    """Named tables under one folder, names cut to 31 characters and kept apart; sheet -> folder."""
    out: dict[str, str] = {}
    for name, df in tables.items():
        short = name[:31]
        k = 2
        while short in out:
            short = f"{name[: 31 - len(str(k)) - 1]}_{k}"
            k += 1
        out[short] = f"{path.rstrip('/')}/{short}"
        df.write.mode("overwrite").parquet(out[short])
    return out


def write_facts(spark: SparkSession, facts: dict, path: str) -> None:
    """A JSON document of single values, as one text file."""
    spark.createDataFrame([(json.dumps(facts, ensure_ascii=False, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def registry_table(spark: SparkSession, groups: dict[str, Sequence[str]]) -> DataFrame:
    """(rule_id, place, number) of a registry held in code."""
    return spark.createDataFrame([(g, i, n) for g, members in groups.items() for i, n in enumerate(members, 1)], "rule_id string, place int, number string")


def inverted(registry: DataFrame, rule: str, number: str) -> DataFrame:
    """(number, groups): the groups of each number, sorted."""
    return registry.groupBy(number).agg(F.array_join(F.array_sort(F.collect_set(rule)), ";").alias("groups"))
