"""Schemas that drift between the files of a feed.

Each record is loaded as a map from field to its raw JSON value, the paths and
types are aggregated by file, objects and arrays to any depth, and successive
files of a feed are compared. The one consistent table is projected from the
same maps: its columns are the fields of all files, joined by the renames that
were found, their types those that most values have; every failed cast is
reported and no value is lost.

Records that aren't a JSON object are no records, ``rejected`` counts them;
marks around the object (byte order mark, blanks, line ends) are taken off.
Lines delivered twice count once. Null payloads, empty tables and feeds with
one file give no changes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip_blank
from ..session import cut

#: JSON types as bits, so that the set of a field's types is one number.
KINDS = {"string": 1, "number": 2, "boolean": 4, "array": 8, "object": 16}
#: Between the names of a nested path; shown as a point.
STEP = "\x1f"


def _body(payload: str) -> Column:
    """The text of a JSON object without what is around it, null where it doesn't begin as one."""
    body = strip_blank(F.col(payload))
    return F.when(body.startswith("{"), body)


def parsed(df: DataFrame, payload: str, by: Sequence[str], line: str) -> DataFrame:
    """(by.., line, fields): each delivery of each valid record, as a map from field to its raw value.

    Objects with a field twice aren't valid records.
    """
    fields = F.try_parse_json(_body(payload)).cast("map<string, variant>")
    # out of a generator, so that a filter doesn't parse a second time
    return df.select(*by, line, F.explode(F.array(fields)).alias("fields")).filter(F.col("fields").isNotNull())


def records(df: DataFrame, payload: str, by: Sequence[str], line: str) -> DataFrame:
    """``parsed``, each line once."""
    once = df.groupBy(*by, line).agg(F.min(payload).alias(payload))
    return parsed(once, payload, by, line)


def rejected(df: DataFrame, payload: str, by: Sequence[str], line: str) -> DataFrame:
    """(by.., n_lines, n_rejected): lines of each file, and those that aren't a record."""
    once = df.groupBy(*by, line).agg(F.min(payload).alias(payload)).select(*by, F.try_parse_json(_body(payload)).isNull().alias("_bad"))
    return once.groupBy(*by).agg(F.count(F.lit(1)).alias("n_lines"), F.count_if("_bad").alias("n_rejected"))


def _text(name: Column) -> Column:
    """A field's JSON text, or the bare text of a string; null for a null or absent one."""
    return F.element_at("fields", name).cast("string")


def _merged(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """left joined with right by sorting both, whatever their estimated sizes.

    Both grow with the number of files, and the planner takes a table of paths,
    which comes out of parsed payloads, for a fiftieth of the compressed input:
    it would send all of it to the driver to broadcast it.
    """
    return left.join(right.hint("merge"), list(keys), how)


@lru_cache(4096)
def flattened(schema: str) -> tuple[tuple[str, int], ...]:
    """(path below the value, bit of its type) of all levels of a variant's schema, the value itself first."""
    out: list[tuple[str, int]] = []

    def name(i: int) -> tuple[str, int]:
        if schema[i] != "`":
            end = schema.index(":", i)
            return schema[i:end], end
        end, got = i + 1, ""
        while schema[end] != "`" or schema[end + 1 : end + 2] == "`":
            got, end = got + schema[end], end + (2 if schema[end] == "`" else 1)
        return got, end + 1

    def value(i: int, path: str) -> int:
        if schema.startswith("OBJECT<", i):
            out.append((path, KINDS["object"]))
            i += 7
            while schema[i] != ">":
                key, i = name(i)
                i = value(i + 2, path + STEP + key)  # after the colon and a blank
                i += 2 if schema.startswith(", ", i) else 0
            return i + 1
        if schema.startswith("ARRAY<", i):
            out.append((path, KINDS["array"]))
            return value(i + 6, path + STEP + "[]") + 1
        end = i
        while end < len(schema) and schema[end] not in ",>" or schema.startswith("DECIMAL", i) and schema[end - 1 : end] != ")":
            end += 1
        kind = schema[i:end]
        bit = {"STRING": 1, "BOOLEAN": 4, "VOID": 0, "VARIANT": 0}.get(kind, 2)
        out.append((path, bit))
        return end

    value(0, "")
    return tuple(out)


def path_kinds(recs: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by.., path, parent, kinds): the paths of each file with the set of their types that aren't null, as bits.

    Values are summed up to their distinct schemas where they are read; only
    those few are taken apart.
    """
    entry = F.explode(F.arrays_zip(F.map_keys("fields").alias("path"), F.map_values("fields").alias("value"))).alias("_e")
    seen = recs.select(*by, entry).select(*by, F.col("_e.path").alias("path"), F.schema_of_variant("_e.value").alias("schema")).distinct()
    n = len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, paths, parents, bits = [], [], [], []
            for i, (path, schema) in enumerate(zip(b.column(n).to_pylist(), b.column(n + 1).to_pylist())):
                for below, bit in flattened(schema):
                    at.append(i)
                    paths.append(path + below)
                    parents.append((path + below).rpartition(STEP)[0])
                    bits.append(bit)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(take) for i in range(n)), pa.array(paths, pa.string()), pa.array(parents, pa.string()), pa.array(bits, pa.int32())], [*b.schema.names[:n], "path", "parent", "kinds"])

    kinds = ", ".join(f"`{c}` {recs.schema[c].dataType.simpleString()}" for c in by)
    # by file: what is summed up by file from these rows isn't shuffled again
    return seen.mapInArrow(run, f"{kinds}, path string, parent string, kinds int").repartition(*by).groupBy(*by, "path", "parent").agg(F.bit_or("kinds").alias("kinds"))


def schema_changes(recs: DataFrame, feed: str, seq: str, identity: str) -> DataFrame:
    """(feed, seq, change_kind, field_before, field_after) between successive files; recs are ``parsed`` or ``records``.

    A field is in a file if any valid record has it; its type is the set of the
    types of its values that aren't null, null-only fields have none. A field
    that goes is renamed to one that comes if they hold the same values for
    more than half of the records (by ``identity``) that are in both files and
    have either value; the best such partner counts, ties by name. Nested
    fields are compared where what holds them is of the same kind in both
    files, and come as paths with points; they are added, removed or retyped.

    The statistics by file are summed before they are shuffled; values are
    read again, and shuffled as 64-bit hashes, for steps where fields both go
    and come. Nothing that grows with the files goes to the driver.
    """
    per_file = cut(path_kinds(recs, [feed, seq]))
    order = Window.partitionBy(feed).orderBy(seq)
    files = per_file.select(feed, seq).distinct().withColumn("prev", F.lag(seq).over(order)).withColumn("next", F.lead(seq).over(order))
    # each file as the later of one step and the earlier of the next
    none = F.lit(None).cast("int")
    step = lambda at, prev, k0, k1: F.struct(at.alias(seq), prev.alias("prev"), k0.alias("k0"), k1.alias("k1"))
    placed = _merged(per_file, files, [feed, seq]).select(feed, "path", "parent", F.explode(F.array(step(F.col(seq), F.col("prev"), none, F.col("kinds")), step(F.col("next"), F.col(seq), F.col("kinds"), none))).alias("_s"))
    steps = placed.select(feed, "_s.*", "path", "parent").filter(F.col("prev").isNotNull() & F.col(seq).isNotNull())
    # by file, as the join sorted them: rows of a file stay beside each other and take less room in the shuffle
    both = cut(steps.repartition(feed, seq).groupBy(feed, seq, "prev", "path", "parent").agg(F.max("k0").alias("k0"), F.max("k1").alias("k1")).filter("k0 is null or k1 is null or k0 <> k1 or k0 >= 8"))
    top, below = both.filter("parent = ''"), both.filter("parent <> ''")
    holds = both.filter("k0 = k1 and k0 >= 8").select(feed, seq, F.col("path").alias("parent"))
    below = _merged(below, holds, [feed, seq, "parent"], "left_semi")
    gone = top.filter("k1 is null").select(feed, seq, "prev", F.col("path").alias("field_before"))
    come = top.filter("k0 is null").select(feed, seq, "prev", F.col("path").alias("field_after"))

    # values of the fields that go, and of those that come, by record of the steps that have both
    turns = top.groupBy(feed, seq, "prev").agg(F.collect_set(F.when(F.col("k1").isNull(), F.col("path"))).alias("gone"), F.collect_set(F.when(F.col("k0").isNull(), F.col("path"))).alias("come")).filter("size(gone) > 0 and size(come) > 0")
    ident = _text(F.lit(identity))
    sides = turns.select(feed, seq, F.explode(F.array(F.struct(F.col("prev").alias("at"), F.lit(0).alias("side"), F.col("gone").alias("names")), F.struct(F.col(seq).alias("at"), F.lit(1).alias("side"), F.col("come").alias("names")))).alias("_s")).select(feed, seq, "_s.*")
    hashed = F.transform_values(F.col("fields").cast("map<string, string>"), lambda _, v: F.when(v.isNotNull(), F.xxhash64(v)))
    held = _merged(recs.filter(ident.isNotNull()).select(F.col(feed), F.col(seq).alias("at"), ident.alias("ident"), hashed.alias("hashes")), sides, [feed, "at"])
    held = held.select(feed, seq, "side", "ident", F.transform("names", lambda c: F.struct(c.alias("name"), F.element_at("hashes", c).alias("value"))).alias("vals"))
    mine = lambda side: F.max(F.when(F.col("side") == side, F.col("vals")))
    met = held.groupBy(feed, seq, "ident").agg(mine(0).alias("a"), mine(1).alias("b")).filter("a is not null and b is not null")
    x = met.select(feed, seq, F.explode("a").alias("a"), "b").select(feed, seq, "a", F.explode("b").alias("b"))
    scored = (
        x.groupBy(feed, seq, F.col("a.name").alias("field_before"), F.col("b.name").alias("field_after"))
        .agg(F.count_if(F.col("a.value") == F.col("b.value")).alias("same"), F.count_if(F.col("a.value").isNotNull() | F.col("b.value").isNotNull()).alias("either"))
        .filter(F.col("same") * 2 > F.col("either"))
    )
    best = lambda side, other: F.row_number().over(Window.partitionBy(feed, seq, side).orderBy(F.desc("same"), other))
    renamed = cut(scored.withColumn("a", best("field_before", "field_after")).withColumn("b", best("field_after", "field_before")).filter("a = 1 and b = 1").select(feed, seq, "field_before", "field_after"))
    shape = lambda df, kind, x, y: df.select(feed, seq, F.lit(kind).alias("change_kind"), x.alias("field_before"), y.alias("field_after"))
    shown = F.regexp_replace("path", STEP + r"(\[\])?", ".$1")
    inner = F.when(F.col("k0").isNull(), "added").when(F.col("k1").isNull(), "removed").when((F.col("k0") > 0) & (F.col("k1") > 0) & (F.col("k0") != F.col("k1")), "retyped")
    nested = below.select(feed, seq, inner.alias("change_kind"), F.when(F.col("k0").isNull(), "").otherwise(shown).alias("field_before"), F.when(F.col("k1").isNull(), "").otherwise(shown).alias("field_after")).filter("change_kind is not null")
    return (
        shape(_merged(come, renamed, [feed, seq, "field_after"], "left_anti"), "added", F.lit(""), F.col("field_after"))
        .unionByName(shape(_merged(gone, renamed, [feed, seq, "field_before"], "left_anti"), "removed", F.col("field_before"), F.lit("")))
        .unionByName(shape(renamed, "renamed", F.col("field_before"), F.col("field_after")))
        .unionByName(shape(top.filter("k0 > 0 and k1 > 0 and k0 <> k1"), "retyped", F.col("path"), F.col("path")))
        .unionByName(nested)
    )


def _groups(names: Counter, links: Sequence[tuple[str, str, int]], together: set[frozenset[str]]) -> list[list[str]]:
    """Names joined by renames, the most frequent links first, unless two names of one group stand in one file."""
    group = {n: [n] for n in names}
    for a, b, _ in sorted(links, key=lambda x: (-x[2], x[0], x[1])):
        x, y = group.get(a), group.get(b)
        if x is None or y is None or x is y or any(frozenset((m, n)) in together for m in x for n in y):
            continue
        x += y
        for n in y:
            group[n] = x
    unique = {id(g): sorted(g, key=lambda n: (-names[n], n)) for g in group.values()}
    return sorted(unique.values(), key=lambda g: (-sum(names[n] for n in g), g))


def inferred_columns(recs: DataFrame, feed: str, seq: str, identity: str, reserved: Sequence[str] = ()) -> dict[str, tuple[str, list[str]]]:
    """Column -> (type, names of its field): all fields of all files, joined by the renames between files.

    A column goes by the name that most records use, and has the type of most
    of its values: bigint where all numbers are whole, else double; boolean; or
    string, also for arrays and objects as JSON. Two names that stand in one
    file are never joined. The driver receives the distinct field names with
    their counts, the renames between them, and which of those meet in a file.
    """
    entry = F.explode(F.arrays_zip(F.map_keys("fields").alias("path"), F.map_values("fields").alias("value"))).alias("_e")
    s = F.schema_of_variant("_e.value")
    kind = F.when(s == "BOOLEAN", "boolean").when(s.startswith("BIGINT"), "bigint").when(s.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "double").when(s != "VOID", "string")
    per_file = cut(recs.select(feed, seq, entry).groupBy(feed, seq, F.col("_e.path").alias("path"), kind.alias("kind")).agg(F.count(F.lit(1)).alias("n")))
    names, kinds = Counter(), {}
    for r in per_file.groupBy("path", "kind").agg(F.sum("n").alias("n")).collect():
        names[r["path"]] += r["n"]
        kinds.setdefault(r["path"], Counter())[r["kind"]] += r["n"]
    links = [tuple(r) for r in schema_changes(recs, feed, seq, identity).filter("change_kind = 'renamed'").groupBy("field_before", "field_after").agg(F.count(F.lit(1)).alias("n")).collect()]
    linked = {n for a, b, _ in links for n in (a, b)}
    sets = per_file.filter(F.col("path").isin(list(linked))).groupBy(feed, seq).agg(F.array_sort(F.collect_set("path")).alias("a")).select("a").distinct()
    pairs = sets.select(F.explode("a").alias("x"), "a").select("x", F.explode("a").alias("y")).filter("x < y").distinct().collect() if linked else []
    together = {frozenset((r["x"], r["y"])) for r in pairs}
    out: dict[str, tuple[str, list[str]]] = {}
    taken = {c.lower() for c in (*reserved, "failed_casts", "rest", "fields")}
    for group in _groups(names, links, together):
        n = sum((kinds[g] for g in group), Counter())
        number = n["bigint"] + n["double"]
        most = max(("string", n["string"]), ("boolean", n["boolean"]), ("double" if n["double"] else "bigint", number), key=lambda x: (x[1], x[0]))
        column = group[0]
        while column.lower() in taken:
            column += "_"
        taken.add(column.lower())
        out[column] = (most[0] if most[1] else "string", group)
    return out


def consistent_table(recs: DataFrame, by: Sequence[str], line: str, columns: Mapping[str, tuple[str, Sequence[str]]]) -> DataFrame:
    """One typed row per record: column -> (type, field names it goes by, the first with a value counts).

    ``failed_casts`` lists the columns whose value is there but can't be read
    as the column's type, joined by commas. ``rest`` is a JSON object of all
    values that no column holds, by field name and in their own JSON types:
    fields that aren't named, further names of a column, and failed casts; null
    if there are none. A projection without any shuffle.
    """
    quoted = lambda c: "`" + c.replace("`", "``") + "`"
    name = lambda names: F.coalesce(*[F.when(_text(F.lit(n)).isNotNull(), F.lit(n)) for n in names])
    wide = recs.select(*by, line, "fields", *[name(names).alias(f"_from_{i}") for i, (_, names) in enumerate(columns.values())])
    wide = wide.select(*by, line, "fields", *[f"_from_{i}" for i in range(len(columns))], *[F.element_at("fields", F.col(f"_from_{i}")).cast("string").alias(c) for i, c in enumerate(columns)])
    typed = {c: F.expr(f"try_cast({quoted(c)} as {kind})") for c, (kind, _) in columns.items()}
    failed = F.concat_ws(",", *[F.when(F.col(quoted(c)).isNotNull() & typed[c].isNull(), c) for c in columns])
    held = F.array_compact(F.array(*[F.when(typed[c].isNotNull(), F.col(f"_from_{i}")) for i, c in enumerate(columns)]))
    wide = wide.withColumn("_held", held)
    rest = F.map_filter("fields", lambda k, v: v.cast("string").isNotNull() & ~F.array_contains("_held", k))
    return wide.select(*by, line, *[typed[c].alias(c) for c in columns], failed.alias("failed_casts"), F.when(F.size(rest) > 0, F.to_json(rest)).alias("rest"))
