"""Queries of the general data problems (3, 4, 5, 7)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import key_form
from ..operators import drift, orphans, packed, reconcile
from ..session import cut, table

PACKED = [
    ("group_membership_v1_50", "case_id", ["candidate_official_groups"]),
    ("mixture_candidates_seed", "seed_id", ["target_components", "candidate_components"]),
]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Members of the packed fields that hold two or more."""
    parts = [packed.unpack(_once(spark, d, name, key, fields), key, fields, least=2).select(F.lit(name).alias("table_name"), "record_id", "field_name", "pos", "value") for name, key, fields in PACKED]
    return reduce(DataFrame.unionByName, parts)


def _once(spark: SparkSession, d: str, name: str, key: str, fields: list[str]) -> DataFrame:
    """One row a record, its first delivery, before its fields are split into many; rows without a key are none."""
    first = F.min(F.struct("loaded_at", *fields)).alias("_s")  # deliveries of one time by their content
    return table(spark, d, name).filter(F.col(key).isNotNull()).groupBy(key).agg(first).select(key, *[F.col(f"_s.{f}").alias(f) for f in fields])


def p3_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Number of records by table, field and number of members, single values included."""
    parts = [packed.unpack(_once(spark, d, name, key, fields), key, fields).withColumn("table_name", F.lit(name)) for name, key, fields in PACKED]
    per = reduce(DataFrame.unionByName, parts).groupBy("table_name", "field_name", "record_id").agg(F.max("pos").alias("n_members"))
    return per.groupBy("table_name", "field_name", "n_members").agg(F.count(F.lit(1)).alias("n_records"))


REFERENCES = [
    ("broad_salt_validation_cases", "case_id", "rule_id", "broad_salt_rules_curated_13"),
    ("group_membership_v1_50", "case_id", "rule_id", "group_rules"),
    ("chemical_group_candidates_seed", "seed_id", "target_rule_id", "group_rules"),
    ("mixture_regulatory_reference", "target_id", "target_scope_id", "mixture_candidates_seed"),
]
TARGETS = [
    ("broad_salt_rules_curated_13", "rule_id", "loaded_at", None),
    ("group_rules", "rule_id", "loaded_at", "deleted_at"),
    ("mixture_candidates_seed", "target_scope_id", "loaded_at", None),
]


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    refs = [orphans.references(table(spark, d, name), name, key, target, [ref], "loaded_at") for name, key, ref, target in REFERENCES]
    known = [orphans.targets(table(spark, d, name), name, [key], first, deleted) for name, key, first, deleted in TARGETS]
    gone = orphans.targets(table(spark, d, "key_deletions"), F.col("table_name"), ["key_value"], None, "deleted_at")
    return orphans.find_orphans(reduce(DataFrame.unionByName, refs), reduce(DataFrame.unionByName, [*known, gone]))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references with their reason."""
    return _orphans(spark, d).select("table_name", "record_id", "reason")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per table, month of arrival and reason."""
    return orphans.orphan_counts(_orphans(spark, d))


def p4_composite(spark: SparkSession, d: str) -> DataFrame:
    """Cases whose pair of rule and designation, either of them missing, no curated rule of their time has."""
    pair = ["rule_id", "designation_id"]
    refs = orphans.references(table(spark, d, "broad_salt_validation_cases"), "broad_salt_validation_cases", "case_id", "rules", pair, "loaded_at")
    rules = table(spark, d, "broad_salt_rules_curated_13")
    gone = table(spark, d, "key_deletions").filter("table_name = 'broad_salt_rules_curated_13'").select(key_form(F.col("key_value")).alias("_k"), "deleted_at").groupBy("_k").agg(F.min("deleted_at").alias("deleted_at"))
    dated = rules.join(gone, key_form(F.col("rule_id")) == F.col("_k"), "left")
    return orphans.find_orphans(refs, orphans.targets(dated, "rules", pair, "loaded_at", "deleted_at"), 2, "partial").select("record_id", "reason")


_FEED = ("payload", ["feed_id", "file_seq"], "line_no")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Schema changes between successive files of each feed."""
    return drift.schema_changes(drift.parsed(table(spark, d, "rule_file_records"), *_FEED), "feed_id", "file_seq", "reference_parent_cas")


def p5_table(spark: SparkSession, d: str) -> DataFrame:
    """All rule files as one typed table of all their fields, with the casts that failed and the values that no column holds."""
    recs = cut(drift.records(table(spark, d, "rule_file_records"), *_FEED))  # parsed once, used for the columns and the table
    by = ["feed_id", "file_seq"]
    return drift.consistent_table(recs, by, "line_no", drift.inferred_columns(recs, *by, "reference_parent_cas", [*by, "line_no"]))


def p5_rejected(spark: SparkSession, d: str) -> DataFrame:
    """Lines of each rule file and those that are no record."""
    return drift.rejected(table(spark, d, "rule_file_records"), *_FEED)


COPIES = {
    "broad_salt_rules": ("broad_salt_rules", "broad_salt_rules_curated_13", "rule_id", ["designation_id", "reference_parent_name", "reference_parent_cas", "reference_smiles", "salt_scope", "source_verified"]),
    "identity_e2e": ("identity_e2e_v6_72", "identity_e2e_copy", "case_id", ["reference_parent_name", "reference_parent_cas", "candidate_name", "candidate_cas", "reference_membership", "difficulty"]),
}


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows on one side only and fields that differ, of both pairs of copies."""
    sides, rows, width = [], 0, max(len(c[3]) for c in COPIES.values())
    for dataset, (first, second, key, fields) in COPIES.items():
        for side, name in enumerate((first, second)):
            df = table(spark, d, name)
            rows += df.count()
            sides.append(reconcile.keyed(df, dataset, side, key, fields, width))
    return reconcile.differences(reduce(DataFrame.unionByName, sides), {k: v[3] for k, v in COPIES.items()}, reconcile.bucket_count(rows))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Number of differences by dataset and kind."""
    return p7_found(spark, d).groupBy("dataset", "difference").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {q.__name__: q for q in (p3_found, p3_sizes, p4_found, p4_report, p4_composite, p5_found, p5_table, p5_rejected, p7_found, p7_report)}
_BL = r"[\s\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200d}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]"
_strip = lambda c: f"regexp_replace(regexp_replace({c}, '^{_BL}+', ''), '{_BL}+$', '')"
_key = lambda c: f"nullif(lower({_strip(c)}), '')"
_ORPHANS = f"""with r as ({" union all ".join(f"select '{t}' as table_name, {i} as record_id, {_key(k)} as k, '{g}' as target, loaded_at from {t}" for t, i, k, g in REFERENCES)}),
o as (select table_name, record_id, k, target, min(loaded_at) as seen_at from r where k is not null group by 1, 2, 3, 4),
g as ({" union all ".join(f"select '{t}' as target, {_key(k)} as k, {f} as first_at, {x or 'null::timestamp'} as deleted_at from {t}" for t, k, f, x in TARGETS)}
 union all select table_name, {_key("key_value")}, null::timestamp, deleted_at from key_deletions),
m as (select target, k, min(first_at) as first_at, min(deleted_at) as deleted_at from g group by 1, 2 having min(first_at) is not null),
f as (select table_name, record_id, seen_at, case when first_at is null then 'missing' when deleted_at <= seen_at then 'deleted' when first_at > seen_at then 'late' end as reason from o left join m on o.target = m.target and o.k = m.k)
"""
_value = lambda c: f"(select case when v = 'true' then '1' when v = 'false' then '0' else v end from (select lower(regexp_replace({_strip(f"coalesce(cast({c} as varchar), '')")}, '[\\x{{2010}}-\\x{{2015}}\\x{{2212}}\\x{{fe58}}\\x{{fe63}}\\x{{ff0d}}\\x{{ad}}]', '-', 'g')) as v))"


def _copies_sql() -> str:
    joins, rows = [], []
    for n, (dataset, (first, second, key, fields)) in enumerate(COPIES.items()):
        one = lambda t: f"(select {_strip(key)} as k, {', '.join(f'min({_value(f)}) as {f}' for f in fields)} from {t} where {key} is not null group by 1)"
        joins.append(f"j{n} as (select coalesce(a.k, b.k) as record_id, a.k as ak, b.k as bk, {', '.join(f'a.{f} as a_{f}, b.{f} as b_{f}' for f in fields)} from {one(first)} a full join {one(second)} b on a.k = b.k)")
        rows.append(f"select '{dataset}' as dataset, record_id, 'only_first' as difference from j{n} where bk is null union all select '{dataset}', record_id, 'only_second' from j{n} where ak is null")
        rows += [f"select '{dataset}', record_id, '{f}' from j{n} where ak is not null and bk is not null and a_{f} <> b_{f}" for f in fields]
    return f"with {', '.join(joins)}, f as ({' union all '.join(rows)})"


_COPIES = _copies_sql()
_RECORDS = f"""with once as (select feed_id, file_seq, line_no, min(payload) as payload from rule_file_records group by 1, 2, 3), body as (select feed_id, file_seq, line_no, {_strip("payload")} as p from once),
good as (select *, coalesce(starts_with(p, '{{') and json_valid(p), false) as ok from body), r as (select feed_id, file_seq, p, json_extract_string(p, '$.reference_parent_cas') as ident from good where ok)"""
_CHANGES = _RECORDS + """,
v as (select feed_id, file_seq, ident, k, json_extract(p, '$."' || k || '"') as j from (select *, unnest(json_keys(p)) as k from r)),
t as (select feed_id, file_seq, ident, k, case when json_type(j) in ('UBIGINT', 'BIGINT', 'DOUBLE') then 'number' when json_type(j) <> 'NULL' then json_type(j) end as kind, case when json_type(j) <> 'NULL' then coalesce(j ->> '$', cast(j as varchar)) end as x from v),
f as (select feed_id, file_seq, k, array_to_string(list_sort(list(distinct kind)), '|') as kinds from t group by 1, 2, 3),
s as (select feed_id, file_seq, lag(file_seq) over (partition by feed_id order by file_seq) as prev from (select distinct feed_id, file_seq from f)),
n as (select s.feed_id, s.file_seq, prev, k, kinds from s join f on f.feed_id = s.feed_id and f.file_seq = s.file_seq where prev is not null), o as (select s.feed_id, s.file_seq, prev, k, kinds from s join f on f.feed_id = s.feed_id and f.file_seq = s.prev),
b as (select coalesce(n.feed_id, o.feed_id) as feed_id, coalesce(n.file_seq, o.file_seq) as file_seq, coalesce(n.prev, o.prev) as prev, o.k as old, n.k as new, o.kinds as k0, n.kinds as k1 from n full join o on n.feed_id = o.feed_id and n.file_seq = o.file_seq and n.k = o.k),
g as (select * from b where new is null), c as (select * from b where old is null),
w as (select distinct on (feed_id, file_seq, ident, k) feed_id, file_seq, ident, k, x from t where ident is not null), i as (select distinct feed_id, file_seq, ident from r where ident is not null),
p as (select g.feed_id, g.file_seq, g.old, c.new, count(*) filter (a.x = z.x) as same, count(*) filter (a.x is not null or z.x is not null) as either from g join c on g.feed_id = c.feed_id and g.file_seq = c.file_seq
 join i ia on ia.feed_id = g.feed_id and ia.file_seq = g.prev join i iz on iz.feed_id = g.feed_id and iz.file_seq = g.file_seq and iz.ident = ia.ident
 left join w a on a.feed_id = ia.feed_id and a.file_seq = ia.file_seq and a.ident = ia.ident and a.k = g.old left join w z on z.feed_id = iz.feed_id and z.file_seq = iz.file_seq and z.ident = iz.ident and z.k = c.new group by 1, 2, 3, 4),
m as (select * from (select *, row_number() over (partition by feed_id, file_seq, old order by same desc, new) as ra, row_number() over (partition by feed_id, file_seq, new order by same desc, old) as rb from p where same * 2 > either) where ra = 1 and rb = 1)
select feed_id, file_seq, 'renamed' as change_kind, old as field_before, new as field_after from m
union all select feed_id, file_seq, 'added', '', new from c where not exists (select 1 from m where m.feed_id = c.feed_id and m.file_seq = c.file_seq and m.new = c.new)
union all select feed_id, file_seq, 'removed', old, '' from g where not exists (select 1 from m where m.feed_id = g.feed_id and m.file_seq = g.file_seq and m.old = g.old)
union all select feed_id, file_seq, 'retyped', old, new from b where k0 <> k1 and k0 <> '' and k1 <> ''"""
SQL = {
    "p4_found": _ORPHANS + "select table_name, record_id, reason from f where reason is not null",
    "p4_report": _ORPHANS + "select table_name, strftime(seen_at, '%Y-%m') as month, reason, count(*) as n from f where reason is not null group by 1, 2, 3",
    "p4_composite": f"""with r as (select case_id as record_id, {_key("rule_id")} as a, {_key("designation_id")} as b, min(loaded_at) as t from broad_salt_validation_cases group by 1, 2, 3),
x as (select {_key("key_value")} as k, min(deleted_at) as x from key_deletions where table_name = 'broad_salt_rules_curated_13' group by 1),
g as (select {_key("rule_id")} as a, {_key("designation_id")} as b, min(loaded_at) as f from broad_salt_rules_curated_13 group by 1, 2), k as (select g.*, x from g left join x on g.a = x.k),
whole as (select record_id, case when f is null then 'missing' when x <= t then 'deleted' when f > t then 'late' end as reason from r left join k on r.a = k.a and r.b = k.b where r.a is not null and r.b is not null),
m as (select r.a, r.b, t, count(f) as n, count(*) filter (f <= t) as come, count(*) filter (f <= t and (x is null or greatest(x, f) > t)) as live from (select distinct a, b, t from r where (a is null) <> (b is null)) r
 left join k on (r.a is null or r.a = k.a) and (r.b is null or r.b = k.b) group by 1, 2, 3),
part as (select record_id, case when n = 0 then 'missing' when come = 0 then 'late' when live = 0 then 'deleted' end as reason from r join m on r.a is not distinct from m.a and r.b is not distinct from m.b and r.t = m.t)
select record_id, reason from (select * from whole union all select * from part) where reason is not null""",
    "p5_found": _CHANGES,
    "p5_rejected": _RECORDS + " select feed_id, file_seq, count(*) as n_lines, count(*) filter (not ok) as n_rejected from good group by 1, 2",
    "p7_found": _COPIES + " select dataset, record_id, difference from f",
    "p7_report": _COPIES + " select dataset, difference, count(*) as n from f group by 1, 2",
}
