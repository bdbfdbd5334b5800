"""Corrections, carried decisions, quotas, structures and names over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import conditions as C
from ..operators import governance as G
from ..operators import metrics, windows
from ..session import table
from .evaluation import _CASES, _CELLS, _cases, _cells
from .registry import Registry

R = Registry()
query = R.query
QUERIES, SQL = R.queries, R.sql

_ONE = "select case_id, {0} from (select *, row_number() over (partition by case_id order by loaded_at) as rn from {1}) where rn = 1"


def _one(spark: SparkSession, d: str, name: str, *cols: str) -> DataFrame:
    """First delivery of each case."""
    return table(spark, d, name).groupBy("case_id").agg(F.min_by(F.struct(*cols), "loaded_at").alias("s")).select("case_id", "s.*")


@query(f"""
with a as ({_ONE.format("difficulty, source", "identity_e2e_v6_72")}), b as ({_ONE.format("difficulty, source", "identity_e2e_copy")}),
o as (select a.case_id, a.difficulty as f, b.difficulty as t, b.source as why from a join b on a.case_id = b.case_id where a.difficulty is distinct from b.difficulty),
r as (select a.case_id, case when o.case_id is null then 'NONE' when coalesce(trim(why, ' '), '') = '' then 'NO_EVIDENCE' when a.difficulty is distinct from f then 'FROM_DIFFERS' else 'APPLIED' end as override, a.difficulty as d, t from a left join o on a.case_id = o.case_id)
select override, case when override = 'APPLIED' then t else d end as difficulty, count(*) as n from r group by 1, 2""")
def override_application(spark: SparkSession, d: str) -> DataFrame:
    a, b = _one(spark, d, "identity_e2e_v6_72", "difficulty", "source"), _one(spark, d, "identity_e2e_copy", "difficulty", "source")
    pair = a.alias("a").join(b.alias("b"), "case_id").filter(~F.col("a.difficulty").eqNullSafe(F.col("b.difficulty")))
    o = pair.select("case_id", F.col("a.difficulty").alias("from_value"), F.col("b.difficulty").alias("to_value"), F.col("b.source").alias("evidence"))
    return G.apply_overrides(a, o, "case_id", "difficulty").groupBy("override", "difficulty").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
with a as ({_ONE.format("candidate_name, candidate_cas", "identity_e2e_v6_72")}), b as ({_ONE.format("candidate_name, candidate_cas, difficulty", "identity_e2e_copy")})
select coalesce(b.difficulty, 'PENDING') as difficulty, count(*) as n from a left join b on a.case_id = b.case_id and a.candidate_name is not distinct from b.candidate_name and a.candidate_cas is not distinct from b.candidate_cas group by 1""")
def signoff_carry_over(spark: SparkSession, d: str) -> DataFrame:
    """Decisions of the copy carried to cases whose content is unchanged."""
    a, b = _one(spark, d, "identity_e2e_v6_72", "candidate_name", "candidate_cas"), _one(spark, d, "identity_e2e_copy", "candidate_name", "candidate_cas", "difficulty")
    return G.carry_status(a, b, "case_id", ["candidate_name", "candidate_cas"], "difficulty").groupBy("difficulty").agg(F.count(F.lit(1)).alias("n"))


@query("""
with c as (select case_id, min(split) as split, min(source) as source from identity_e2e_v6_72 group by 1), r as (select *, row_number() over (partition by split, source order by sha256('q7' || case_id), case_id) as k from c)
select split, source, case_id from r where k <= 5""")
def quota_sample(spark: SparkSession, d: str) -> DataFrame:
    """Five cases of each split and source, chosen by a seeded hash."""
    c = table(spark, d, "identity_e2e_v6_72").groupBy("case_id").agg(F.min("split").alias("split"), F.min("source").alias("source"))
    return G.quota_sample(c, ["split", "source"], "case_id", "q7", 5)


@query(f"""{_CASES}{_CELLS} select split, round((tp + tn) / n_total, 6) as correct, round(n_review / n_total, 6) as review, round((fp + fn) / n_total, 6) as incorrect from k""")
def outcome_composition(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_total")
    return _cells(spark, d).select("split", metrics.ratio(F.col("tp") + F.col("tn"), n).alias("correct"), metrics.ratio(F.col("n_review"), n).alias("review"), metrics.ratio(F.col("fp") + F.col("fn"), n).alias("incorrect"))


@query(f"""{_CASES} select source, round(avg(case when pred = truth then 1.0 else 0 end), 6) as acc_a, round(avg(case when truth = 'MATCH' then 1.0 else 0 end), 6) as acc_b,
round(avg(case when truth = 'MATCH' then 1.0 else 0 end) - avg(case when pred = truth then 1.0 else 0 end), 6) as delta from e group by 1""")
def system_delta(spark: SparkSession, d: str) -> DataFrame:
    """A rule against always answering MATCH, by source."""
    a, b = F.avg((F.col("pred") == F.col("truth")).cast("double")), F.avg((F.col("truth") == "MATCH").cast("double"))
    return _cases(spark, d).groupBy("source").agg(F.round(a, 6).alias("acc_a"), F.round(b, 6).alias("acc_b"), F.round(b - a, 6).alias("delta"))


@query("""
select p_partkey, case when p_size % 5 = 0 then 'RULE' when p_size % 3 = 0 then 'MODEL' else 'REVIEW' end as base, case when p_size % 5 = 0 then 'RULE' when p_size % 3 = 0 then case when p_size % 2 = 0 then 'STRUCTURE' else 'MODEL' end else case when p_size % 2 = 0 then 'STRUCTURE' else 'REVIEW' end end as route from part""")
def route_upgrade(spark: SparkSession, d: str) -> DataFrame:
    """Routes improved by an offer, never below a deterministic one."""
    s = F.col("p_size")
    p = table(spark, d, "part").select("p_partkey", F.when(s % 5 == 0, "RULE").when(s % 3 == 0, "MODEL").otherwise("REVIEW").alias("base"), F.when(s % 2 == 0, "STRUCTURE").alias("offer"))
    return p.select("p_partkey", "base", G.upgraded(F.col("base"), F.col("offer"), {"RULE": 1, "STRUCTURE": 2, "MODEL": 3, "REVIEW": 4}, "RULE").alias("route"))


@query("""
with x as (select 'orders' as artifact, coalesce(cast(o_orderkey as varchar), '~') || '|' || coalesce(o_orderstatus, '~') as s from orders union all select 'group_rules', coalesce(rule_id, '~') || '|' || coalesce(scope_text, '~') from group_rules)
select artifact, count(*) as n_rows, cast(sum(cast(cast('0x' || substr(sha256(s), 1, 14) as bigint) as hugeint)) as varchar) || ':' || cast(sum(cast(cast('0x' || substr(sha256(s), 15, 14) as bigint) as hugeint)) as varchar) as digest from x group by 1""")
def freeze_tables(spark: SparkSession, d: str) -> DataFrame:
    """Content digests of named tables."""
    return G.frozen(table(spark, d, "orders"), "orders", ["o_orderkey", "o_orderstatus"]).unionByName(G.frozen(table(spark, d, "group_rules"), "group_rules", ["rule_id", "scope_text"]))


@query("""
with a as (select distinct case_id from identity_e2e_v6_72), b as (select distinct case_id from identity_e2e_copy), j as (select a.case_id as x, b.case_id as y from a full join b on a.case_id = b.case_id)
select count(x) as n_a, count(y) as n_b, count(*) filter (x is not null and y is not null) as n_both, count(x) = count(*) filter (x is not null and y is not null) and count(y) = count(*) filter (x is not null and y is not null) as equal from j""")
def key_set_equality(spark: SparkSession, d: str) -> DataFrame:
    return G.same_keys(table(spark, d, "identity_e2e_v6_72"), table(spark, d, "identity_e2e_copy"), "case_id")


@query("""
select p_partkey, concat_ws(';', case when p_size >= 10 then 'acute' end, case when p_size >= 20 then 'chronic' end, case when p_size >= 40 then 'eco' end) as categories from part""")
def trigger_categories(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", C.joined_labels({"acute": s >= 10, "chronic": s >= 20, "eco": s >= 40}).alias("categories"))


@query("""
with n as (select distinct lower(trim(reference_parent_name, ' ')) as name from broad_salt_rules_curated_13 where reference_parent_name is not null)
select name, regexp_replace(regexp_replace(regexp_replace(name, 'ic acid$', 'ate'), 'ous acid$', 'ite'), 'ine$', 'inium') as variant from n""")
def anion_variants(spark: SparkSession, d: str) -> DataFrame:
    """Names a salt of the parent goes by."""
    n = table(spark, d, "broad_salt_rules_curated_13").filter("reference_parent_name is not null").select(F.lower(F.trim("reference_parent_name")).alias("name")).distinct()
    v = F.regexp_replace(F.regexp_replace(F.regexp_replace("name", "ic acid$", "ate"), "ous acid$", "ite"), "ine$", "inium")
    return n.select("name", v.alias("variant"))


@query("""
with s as (select distinct smiles from broad_salt_validation_cases where trim(smiles, ' ') <> '')
select regexp_matches(smiles, '(^|[^A-Za-z])Na($|[^a-z])') as has_sodium, regexp_matches(smiles, '(^|[^A-Za-z])Cl($|[^a-z])') as has_chlorine, contains(smiles, '.') as multicomponent, count(*) as n from s group by 1, 2, 3""")
def element_presence(spark: SparkSession, d: str) -> DataFrame:
    """Elements and components read from structure strings without a chemistry engine."""
    s = table(spark, d, "broad_salt_validation_cases").filter("trim(smiles) <> ''").select("smiles").distinct()
    has = lambda e: F.col("smiles").rlike(f"(?<![A-Za-z]){e}(?![a-z])")
    return s.groupBy(has("Na").alias("has_sodium"), has("Cl").alias("has_chlorine"), F.col("smiles").contains(".").alias("multicomponent")).agg(F.count(F.lit(1)).alias("n"))


_Q = r"(?i)(\d+(?:\.\d+)?)[\s\p{Z}]*(kg|킬로그램|ton|tons|톤|t)(?:[^\p{L}\p{N}_]|$)"


@query(f"""
with q as (select regexp_extract(payload, '{_Q}', 1) as v, lower(regexp_extract(payload, '{_Q}', 2)) as unit from rule_file_records where payload is not null)
select unit, count(*) as n, cast(round(sum(try_cast(v as double)), 3) as double) as total from q group by 1""")
def quantity_conditions(spark: SparkSession, d: str) -> DataFrame:
    """First quantity with a unit of each rule record."""
    value, unit = C.quantity(F.col("payload"))
    q = table(spark, d, "rule_file_records").filter("payload is not null").select(value.alias("v"), unit.alias("unit"))
    return q.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 3).alias("total"))


@query("""
with r as (select *, row_number() over (partition by gold_label order by seed_id) as k from (select seed_id, min(gold_label) as gold_label from chemical_group_candidates_seed group by 1) where gold_label is not null)
select seed_id, gold_label, k * 2 - case when gold_label = 'MATCH' then 1 else 0 end as place from r""")
def alternating_order(spark: SparkSession, d: str) -> DataFrame:
    """Labels in turns: places from each label's own order."""
    r = table(spark, d, "chemical_group_candidates_seed").groupBy("seed_id").agg(F.min("gold_label").alias("gold_label")).filter("gold_label is not null")
    p = windows.place(r, "gold_label", ["seed_id"])
    return p.select("seed_id", "gold_label", (F.col("place") * 2 - F.when(F.col("gold_label") == "MATCH", 1).otherwise(0)).alias("place"))
