"""Screening, joins, diffs and membership decisions over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diff, screen, votes
from ..session import table
from .registry import Registry

R = Registry()
query = R.query
QUERIES, SQL = R.queries, R.sql


@query("""
with rules as (select p_type, round(avg(p_size) / 10, 2) as lim from part group by p_type),
j as (select l_orderkey, l_linenumber, l_partkey, l_quantity, round(l_discount * 100, 4) as conc, lim, p.p_type, p_size from lineitem left join part p on l_partkey = p_partkey left join rules r on p.p_type = r.p_type)
select p_type, case when p_size % 17 = 0 then 'EXCLUDED' when conc is null then 'VALUE_MISSING' when lim is null then 'LIMIT_MISSING' when conc >= lim then 'TRIGGERED' else 'BELOW' end as status,
count(*) as n, cast(round(sum(l_quantity), 2) as double) as quantity from j group by 1, 2""")
def screen_threshold_status(spark: SparkSession, d: str) -> DataFrame:
    """Order lines screened against the limits of their part's type: status per type."""
    part = table(spark, d, "part").select("p_partkey", "p_type", "p_size")
    rules = part.groupBy("p_type").agg(F.round(F.avg("p_size") / 10, 2).alias("lim"))
    lines = table(spark, d, "lineitem").select("l_partkey", "l_quantity", F.round(F.col("l_discount") * 100, 4).alias("conc"))
    hit = lines.join(part, lines.l_partkey == part.p_partkey, "left").join(rules, "p_type", "left")
    return hit.groupBy("p_type", screen.status(F.col("conc"), F.col("lim"), F.col("p_size") % 17 == 0).alias("status")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("""
select threshold_operator, case when threshold_operator = '>=' then threshold_pct * f >= threshold_pct - 1e-12 when threshold_operator = '>' then threshold_pct * f > threshold_pct + 1e-12 end as meets,
f as factor, count(*) as n from group_rules cross join (values (0.99::double), (1.0::double), (1.01::double)) v(f) group by 1, 2, 3""")
def threshold_operator_column(spark: SparkSession, d: str) -> DataFrame:
    """Limits tested just below, at and above, by the rule's own operator."""
    rules = table(spark, d, "group_rules").withColumn("factor", F.explode(F.array(F.lit(0.99), F.lit(1.0), F.lit(1.01))))
    return rules.groupBy("threshold_operator", screen.meets(F.col("threshold_pct") * F.col("factor"), F.col("threshold_pct"), F.col("threshold_operator")).alias("meets"), "factor").agg(F.count(F.lit(1)).alias("n"))


@query("""
select c_custkey, coalesce(o_orderstatus, 'NONE') as status, o_orderkey is not null as triggered, count(*) as n
from customer left join orders on c_custkey = o_custkey group by 1, 2, 3""")
def screen_no_match_sentinel(spark: SparkSession, d: str) -> DataFrame:
    """Orders per customer and status; customers without any get a NONE row."""
    cust = table(spark, d, "customer").select("c_custkey")
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("status"))
    hits = orders.join(cust, "c_custkey", "left_semi").groupBy("c_custkey", "status").agg(F.count(F.lit(1)).alias("n")).withColumn("triggered", F.lit(True))
    return screen.with_no_match(hits, cust, "c_custkey", {"status": F.lit("NONE"), "triggered": F.lit(False), "n": F.lit(1).cast("long")})


@query("""
select r_name, count(distinct s_suppkey) as n_suppliers, count(*) as n_lines, cast(round(sum(l_extendedprice), 2) as double) as price
from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by r_name""")
def bridge_relation_screen(spark: SparkSession, d: str) -> DataFrame:
    """Lines related to regions over the bridge of supplier and nation, pre-aggregated by supplier."""
    lines = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_extendedprice").alias("p"))
    bridge = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return lines.join(bridge, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("r_name").agg(F.count("s_suppkey").alias("n_suppliers"), F.sum("n").alias("n_lines"), F.round(F.sum("p"), 2).alias("price"))


@query("""
with t as (select o_custkey, year(o_orderdate) as y, o_orderstatus || '|' || o_orderpriority as s from orders where year(o_orderdate) in (1999, 2000)),
p as (select o_custkey, s, max(case when y = 1999 then 1 else 0 end) as a, max(case when y = 2000 then 1 else 0 end) as b from t group by 1, 2),
k as (select o_custkey, cast(sum(a) as bigint) as n_old, cast(sum(b) as bigint) as n_new, sum(case when a = 1 and b = 1 then 1 else 0 end) as both_n from p group by 1)
select o_custkey, case when n_old = 0 then 'ADDED' when n_new = 0 then 'REMOVED' when n_old = both_n and n_new = both_n then 'UNCHANGED' else 'MODIFIED' end as change, n_old, n_new from k""")
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    """Signature sets of each customer's orders of 1999 against 2000."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    year = lambda y: o.filter(F.year("o_orderdate") == y)
    return diff.snapshot_diff(year(1999), year(2000), "o_custkey", F.concat_ws("|", "o_orderstatus", "o_orderpriority"))


@query("""
with y as (select o_custkey, o_orderpriority as p, round(avg(case when year(o_orderdate) = 1999 then o_totalprice end), 2) as a, round(avg(case when year(o_orderdate) = 2000 then o_totalprice end), 2) as b
 from orders where year(o_orderdate) in (1999, 2000) group by 1, 2),
l as (select o_custkey, case when a is null or b is null then 'review' when abs(a - b) <= 1e-12 then 'maintained' when b < a then 'strengthened' else 'relaxed' end as w from y),
s as (select o_custkey, list_sort(list(distinct w)) as ls from l group by 1)
select o_custkey, case when list_contains(ls, 'review') then 'review' when ls = ['deleted'] then 'deleted' when ls = ['maintained'] then 'maintained' when ls = ['strengthened'] or ls = ['maintained', 'strengthened'] then 'strengthened'
 when ls = ['relaxed'] then 'relaxed' else 'mixed' end as label, array_to_string(ls, ';') as moves from s""")
def transition_direction(spark: SparkSession, d: str) -> DataFrame:
    """Direction of the mean price by priority, 1999 to 2000, reduced to one label per customer."""
    o = table(spark, d, "orders").withColumn("y", F.year("o_orderdate")).filter(F.col("y").isin(1999, 2000))
    mean = lambda y: F.round(F.avg(F.when(F.col("y") == y, F.col("o_totalprice"))), 2)
    per = o.groupBy("o_custkey", "o_orderpriority").agg(mean(1999).alias("a"), mean(2000).alias("b"))
    sets = per.groupBy("o_custkey").agg(F.array_sort(F.collect_set(screen.direction(F.col("a"), F.col("b")))).alias("moves"))
    return sets.select("o_custkey", diff.overall_label(F.col("moves")).alias("label"), F.array_join("moves", ";").alias("moves"))


@query("""
with a as (select distinct l_partkey, l_suppkey from lineitem where l_linestatus = 'F'), b as (select distinct l_partkey, l_suppkey from lineitem where l_linestatus = 'O'),
u as (select coalesce(a.l_partkey, b.l_partkey) as l_partkey, case when b.l_partkey is null then 'left_only' when a.l_partkey is null then 'right_only' else 'both' end as side
 from a full join b on a.l_partkey = b.l_partkey and a.l_suppkey = b.l_suppkey)
select l_partkey, side, count(*) as n from u group by 1, 2""")
def pair_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """(part, supplier) pairs of finished against open lines."""
    l = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_linestatus")
    return diff.pair_reconciliation(l.filter("l_linestatus = 'F'"), l.filter("l_linestatus = 'O'"), "l_partkey", "l_suppkey")


@query("""
with t as (select o_custkey, max(case when year(o_orderdate) = 1999 and o_totalprice > 200000 then 1 else 0 end) as a, max(case when year(o_orderdate) = 2000 and o_totalprice > 200000 then 1 else 0 end) as b
 from orders where year(o_orderdate) in (1999, 2000) group by 1)
select o_custkey, case when a = 0 and b = 1 then 'NEWLY_TRIGGERED' when a = 1 and b = 0 then 'NO_LONGER' when a = 1 then 'STILL' else 'NEVER' end as impact from t""")
def update_impact(spark: SparkSession, d: str) -> DataFrame:
    """High-value orders per customer, before and after."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderdate", (F.col("o_totalprice") > 200000).alias("high"))
    return diff.impact(o.filter(F.year("o_orderdate") == 1999), o.filter(F.year("o_orderdate") == 2000), ["o_custkey"], "high")


@query("""
with s as (select l_orderkey, array_to_string(list_sort(list(distinct cast(l_partkey as varchar))), '|') as signature from lineitem group by 1),
e as (select l_orderkey as a_key, signature from s where l_orderkey % 2 = 0), o as (select l_orderkey as b_key, signature from s where l_orderkey % 2 = 1)
select a_key, b_key, e.signature from e join o on e.signature = o.signature""")
def set_equality_match(spark: SparkSession, d: str) -> DataFrame:
    """Even and odd orders with the same set of parts."""
    l = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    a, b = l.filter("l_orderkey % 2 = 0").withColumnRenamed("l_orderkey", "a_key"), l.filter("l_orderkey % 2 = 1").withColumnRenamed("l_orderkey", "b_key")
    return screen.same_sets(a, b, "a_key", "b_key", "l_partkey")


@query("""
with s as (select l_orderkey, list_sort(list(distinct cast(l_partkey as varchar))) as ms from lineitem group by 1), c as (select ms, count(*) filter (l_orderkey % 2 = 0) as n_a, count(*) filter (l_orderkey % 2 = 1) as n_b from s group by 1)
select case when l_orderkey % 2 = 0 then 'a' else 'b' end as side, l_orderkey as owner, n_a, n_b from s join c on s.ms = c.ms where n_a > 0 and n_b > 0""")
def set_classes(spark: SparkSession, d: str) -> DataFrame:
    """Even and odd orders by the sets of parts they share, a row per order."""
    l = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    return screen.set_classes(l.filter("l_orderkey % 2 = 0"), l.filter("l_orderkey % 2 = 1"), "l_orderkey", "l_orderkey", "l_partkey").drop("set_id")


@query("""
with m as (select distinct upper(trim(candidate_cas, ' ')) as cas, target_scope_id as target from mixture_candidates_seed where trim(candidate_cas, ' ') <> '' and target_scope_id is not null
 union select distinct upper(trim(official_mixture_cas, ' ')), target_scope_id from mixture_regulatory_reference where trim(official_mixture_cas, ' ') <> '' and target_scope_id is not null)
select cas, count(distinct target) as n_targets, case when count(distinct target) = 1 then 'FOUND:' || min(target) else 'REVIEW' end as outcome from m group by 1""")
def unique_membership_gate(spark: SparkSession, d: str) -> DataFrame:
    """Mixture numbers that belong to exactly one scope, from seeds and references."""
    part = lambda t, c: table(spark, d, t).select(F.upper(F.trim(c)).alias("cas"), F.col("target_scope_id").alias("target")).filter("cas <> '' and target is not null")
    both = part("mixture_candidates_seed", "candidate_cas").unionByName(part("mixture_regulatory_reference", "official_mixture_cas"))
    return screen.unique_target(both, "cas", "target")


@query("""
with m as (select distinct trim(candidate_cas, ' ') as cas, upper(trim(rule_id, ' ')) as rule_id from group_membership_v1_50 where reference_membership = 'MATCH' and trim(candidate_cas, ' ') <> '' and trim(rule_id, ' ') <> ''),
s as (select seed_id, trim(candidate_cas, ' ') as cas, upper(trim(target_rule_id, ' ')) as rule_id, gold_label from (select *, row_number() over (partition by seed_id order by loaded_at) as rn from chemical_group_candidates_seed) where rn = 1),
g as (select s.seed_id, s.gold_label, case when t.cas is not null then 'MATCH' when e.cas is not null then 'NO_MATCH' else 'REVIEW' end as gate
 from s left join m t on s.cas = t.cas and s.rule_id = t.rule_id left join (select distinct cas from m) e on s.cas = e.cas)
select gate, gold_label, count(*) as n from g group by 1, 2""")
def group_gate_crossgroup(spark: SparkSession, d: str) -> DataFrame:
    """Group gate: in the target's registry, only in another's, or unknown; against the gold labels."""
    key = lambda c: F.upper(F.trim(c))
    m = table(spark, d, "group_membership_v1_50").filter("reference_membership = 'MATCH'").select(F.trim("candidate_cas").alias("cas"), key("rule_id").alias("rule_id")).filter("cas <> '' and rule_id <> ''").distinct()
    seeds = table(spark, d, "chemical_group_candidates_seed").groupBy("seed_id").agg(F.min_by(F.struct(F.trim("candidate_cas").alias("cas"), key("target_rule_id").alias("rule_id"), "gold_label"), "loaded_at").alias("s")).select("seed_id", "s.*")
    hit = seeds.join(m.withColumn("here", F.lit(1)), ["cas", "rule_id"], "left").join(m.select("cas").distinct().withColumn("elsewhere", F.lit(1)), "cas", "left")
    gate = F.when(F.col("here").isNotNull(), "MATCH").when(F.col("elsewhere").isNotNull(), "NO_MATCH").otherwise("REVIEW")
    return hit.groupBy(gate.alias("gate"), "gold_label").agg(F.count(F.lit(1)).alias("n"))


@query("""
with r as (select rule_id, threshold_pct, threshold_operator from group_rules),
g as (select distinct upper(trim(rule_id, ' ')) as rule_id, trim(candidate_cas, ' ') as cas, reference_membership from group_membership_v1_50 where trim(candidate_cas, ' ') <> ''),
c as (select g.*, threshold_pct, threshold_operator, f, round(threshold_pct * f, 6) as pct from g join r on g.rule_id = r.rule_id cross join (values (0.5::double), (1.0::double), (1.01::double)) v(f))
select threshold_operator, f as factor, case when reference_membership <> 'MATCH' or reference_membership is null then 'NO_MATCH' when (threshold_operator = '>=' and pct >= threshold_pct - 1e-12) or (threshold_operator = '>' and pct > threshold_pct + 1e-12) then 'MATCH' else 'NO_MATCH' end as decision,
count(*) as n from c group by 1, 2, 3""")
def mixture_gate(spark: SparkSession, d: str) -> DataFrame:
    """Mixture gate: group membership, then the group's limit, on a grid of concentrations."""
    rules = table(spark, d, "group_rules").select("rule_id", "threshold_pct", "threshold_operator")
    m = table(spark, d, "group_membership_v1_50").select(F.upper(F.trim("rule_id")).alias("rule_id"), F.trim("candidate_cas").alias("cas"), "reference_membership").filter("cas <> ''").distinct()
    grid = m.join(rules, "rule_id").withColumn("factor", F.explode(F.array(F.lit(0.5), F.lit(1.0), F.lit(1.01)))).withColumn("pct", F.round(F.col("threshold_pct") * F.col("factor"), 6))
    meets = screen.meets(F.col("pct"), F.col("threshold_pct"), F.col("threshold_operator"))
    decision = F.when((F.col("reference_membership") == "MATCH") & meets, "MATCH").otherwise("NO_MATCH")
    return grid.groupBy("threshold_operator", "factor", decision.alias("decision")).agg(F.count(F.lit(1)).alias("n"))


@query("""
with m as (select l_orderkey, p_type, l_quantity from lineitem join part on l_partkey = p_partkey),
a as (select l_orderkey, bool_or(p_type = (select min(p_type) from part)) as has_all, bool_or(p_type in ((select max(p_type) from part))) as has_any, count(distinct p_type) as n_kinds, cast(round(sum(l_quantity), 4) as double) as total from m group by 1)
select l_orderkey, has_all, has_any, n_kinds, total, case when not (has_all and has_any and n_kinds >= 3) then 'NO_MATCH' when total is null then 'REVIEW' when total >= 100 then 'MATCH' else 'NO_MATCH' end as decision from a""")
def composition_rule(spark: SparkSession, d: str) -> DataFrame:
    """Orders that hold the required part types, one of some others, and enough in sum."""
    part = table(spark, d, "part").select("p_partkey", "p_type")
    lo, hi = part.agg(F.min("p_type"), F.max("p_type")).first()
    m = table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return votes.composition(m, "l_orderkey", "p_type", "l_quantity", [lo], [hi], 3, 100.0)


@query("""
with s as (select p_type, case when row_number() over (order by p_type) % 3 = 0 then 'SIZE' when row_number() over (order by p_type) % 3 = 1 then 'PRICE' else 'MANUAL' end as mode, avg(p_size) as size_limit, avg(p_retailprice) as price_limit from part group by p_type)
select part.p_type, mode, case when mode = 'SIZE' then case when p_size >= size_limit then 'MATCH' else 'NO_MATCH' end when mode = 'PRICE' then case when p_retailprice >= price_limit then 'MATCH' else 'NO_MATCH' end else 'REVIEW_REQUIRED' end as outcome, count(*) as n
from part join s on part.p_type = s.p_type group by 1, 2, 3""")
def nested_loop_specs(spark: SparkSession, d: str) -> DataFrame:
    """Predicates held as rows: each part tested by its own type's spec only, manual ones ask for review."""
    part = table(spark, d, "part").select("p_type", "p_size", "p_retailprice")
    specs = _part_specs(part)
    tests = {"SIZE": F.col("p_size") >= F.col("size_limit"), "PRICE": F.col("p_retailprice") >= F.col("price_limit")}
    return screen.by_mode(part, specs, "p_type", tests, "REVIEW_REQUIRED").groupBy("p_type", "mode", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("""
with s as (select p_type, case when row_number() over (order by p_type) % 3 = 0 then 'SIZE' when row_number() over (order by p_type) % 3 = 1 then 'PRICE' else 'MANUAL' end as mode, avg(p_size) as size_limit, avg(p_retailprice) as price_limit from part group by p_type)
select s.p_type, mode, case when mode = 'SIZE' then case when p_size >= size_limit then 'MATCH' else 'NO_MATCH' end when mode = 'PRICE' then case when p_retailprice >= price_limit then 'MATCH' else 'NO_MATCH' end else 'REVIEW_REQUIRED' end as outcome, count(*) as n
from part cross join s group by 1, 2, 3""")
def nested_loop_all_parts(spark: SparkSession, d: str) -> DataFrame:
    """Predicates held as rows: every part tested by every type's spec, manual ones ask for review of all parts."""
    part = table(spark, d, "part").select("p_type", "p_size", "p_retailprice")
    tests = {"SIZE": ("p_size", F.col("p_size") >= F.col("size_limit")), "PRICE": ("p_retailprice", F.col("p_retailprice") >= F.col("price_limit"))}
    return screen.every_spec(part, _part_specs(part), ["p_type"], tests, "REVIEW_REQUIRED")


def _part_specs(part: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    specs = part.groupBy("p_type").agg(F.avg("p_size").alias("size_limit"), F.avg("p_retailprice").alias("price_limit"))
    n = F.row_number().over(Window.orderBy("p_type"))  # one row per type
    return specs.withColumn("mode", F.when(n % 3 == 0, "SIZE").when(n % 3 == 1, "PRICE").otherwise("MANUAL"))


@query("""
with r as (select p_partkey as partkey, cast(null as varchar) as brand, p_size as points from part where p_size < 10
 union all select null, p_brand, max(p_size) from part group by p_brand),
h as (select l.l_orderkey, p.p_partkey, p.p_brand from lineitem l join part p on l_partkey = p_partkey),
one as (select 'p_partkey' as matched_by, points from h join r on h.p_partkey = r.partkey),
two as (select 'p_brand', points from h join r on r.partkey is null and h.p_brand = r.brand where h.p_partkey not in (select partkey from r where partkey is not null))
select matched_by, count(*) as n, cast(sum(points) as bigint) as points from (select * from one union all select * from two) group by 1""")
def fallback_key_join(spark: SparkSession, d: str) -> DataFrame:
    """Rules by part where there is one, else by brand."""
    part = table(spark, d, "part")
    rules = part.filter("p_size < 10").select("p_partkey", F.lit(None).cast("string").alias("p_brand"), F.col("p_size").alias("points")).unionByName(
        part.groupBy("p_brand").agg(F.max("p_size").alias("points")).withColumn("p_partkey", F.lit(None).cast("long"))
    )
    lines = table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey")).join(part.select("p_partkey", "p_brand"), "p_partkey")
    return screen.fallback_join(lines, rules, "p_partkey", "p_brand", ["points"]).groupBy("matched_by").agg(F.count(F.lit(1)).alias("n"), F.sum("points").alias("points"))


@query("""
with r as (select r_regionkey, unnest([r_regionkey, (r_regionkey + 1) % 5, r_regionkey]) as k from region)
select r_regionkey, n_nationkey, count(distinct k) as n_common from r join nation on n_regionkey = k group by 1, 2""")
def array_overlap_join(spark: SparkSession, d: str) -> DataFrame:
    """Rules with lists of keys met by items that hold one of them."""
    rules = table(spark, d, "region").select("r_regionkey", F.array("r_regionkey", (F.col("r_regionkey") + 1) % 5, "r_regionkey").alias("ks"))
    return screen.overlap_join(rules, "r_regionkey", "ks", table(spark, d, "nation"), "n_nationkey", "n_regionkey")


@query("""
with a as (select p_partkey, min(p_brand) as brand, min(p_type) as kind from part group by 1)
select brand, kind, count(*) as n, cast(round(sum(l_extendedprice * (1 - l_discount)), 2) as double) as revenue from lineitem left join a on l_partkey = p_partkey group by 1, 2""")
def validated_left_join(spark: SparkSession, d: str) -> DataFrame:
    """Many lines to one row a part, made unique first; sums before the join."""
    a = table(spark, d, "part").groupBy("p_partkey").agg(F.min("p_brand").alias("brand"), F.min("p_type").alias("kind"))
    l = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("c"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    return l.join(a, F.col("l_partkey") == F.col("p_partkey"), "left").groupBy("brand", "kind").agg(F.sum("c").alias("n"), F.round(F.sum("r"), 2).alias("revenue"))


@query("""
select coalesce(a.source, b.source) as source, coalesce(n_documents, 0) as n_documents, coalesce(n_targets, 0) as n_targets, coalesce(max_repeats, 0) as max_repeats
from (select source, count(*) as n_documents from documents group by 1) a full join (select source, count(*) as n_targets, max(max_repeats) as max_repeats from mix_targets group by 1) b on a.source = b.source""")
def outer_composition(spark: SparkSession, d: str) -> DataFrame:
    """Sources of documents and of targets, whichever has them; missing counts are 0."""
    a = table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"))
    b = table(spark, d, "mix_targets").groupBy("source").agg(F.count(F.lit(1)).alias("n_targets"), F.max("max_repeats").alias("max_repeats"))
    return a.join(b, "source", "full").fillna(0, ["n_documents", "n_targets", "max_repeats"])


@query("""
with m as (select n_name, r_name from nation join region on n_regionkey = r_regionkey where r_name <> (select max(r_name) from region))
select n_nationkey, nation.n_name, coalesce(m.r_name, 'UNKNOWN') as region from nation left join m on nation.n_name = m.n_name""")
def map_lookup_default(spark: SparkSession, d: str) -> DataFrame:
    """A lookup that gives UNKNOWN for keys the map lacks."""
    region = table(spark, d, "region")
    last = region.agg(F.max("r_name").alias("last"))
    m = table(spark, d, "nation").join(region.join(last, F.col("r_name") != F.col("last")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")
    return table(spark, d, "nation").select("n_nationkey", "n_name").join(m, "n_name", "left").select("n_nationkey", "n_name", F.coalesce("r_name", F.lit("UNKNOWN")).alias("region"))


@query("""
select a, b, place from (select x.n_nationkey as a, y.n_nationkey as b, row_number() over (partition by x.n_nationkey order by y.n_nationkey) as place from nation x join nation y on x.n_nationkey <> y.n_nationkey) where place <= 6""")
def cross_negative_cap(spark: SparkSession, d: str) -> DataFrame:
    """For each rule its first six others by key: from the sorted keys, without pairing all."""
    keys = table(spark, d, "nation").select("n_nationkey")
    first = keys.orderBy("n_nationkey").limit(7).agg(F.array_sort(F.collect_list("n_nationkey")).alias("ks"))
    others = F.slice(F.filter("ks", lambda k: k != F.col("n_nationkey")), 1, 6)
    return keys.crossJoin(F.broadcast(first)).select(F.col("n_nationkey").alias("a"), F.posexplode(others).alias("place", "b")).select("a", "b", (F.col("place") + 1).cast("long").alias("place"))


@query("""
select 'with_orders' as part, count(*) as n from customer where c_custkey in (select o_custkey from orders)
union all select 'without_orders', count(*) from customer where c_custkey not in (select o_custkey from orders where o_custkey is not null)""")
def semi_anti_holdout(spark: SparkSession, d: str) -> DataFrame:
    """Customers with and without orders."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    n = lambda how, name: c.join(o, "c_custkey", how).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
    return n("left_semi", "with_orders").unionByName(n("left_anti", "without_orders"))


@query("""
with f as (select distinct l_partkey, l_suppkey from lineitem where l_linestatus = 'F'), o as (select distinct l_partkey, l_suppkey from lineitem where l_linestatus = 'O')
select 'union' as op, count(*) as n from (select * from f union select * from o) union all select 'intersect', count(*) from (select * from f intersect select * from o) union all select 'except', count(*) from (select * from f except select * from o)""")
def set_ops_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Union, intersection and difference of pairs, from one aggregation."""
    l = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.max((F.col("l_linestatus") == "F").cast("int")).alias("f"), F.max((F.col("l_linestatus") == "O").cast("int")).alias("o"))
    n = l.agg(F.count_if(F.expr("f + o > 0")).alias("u"), F.count_if(F.expr("f + o = 2")).alias("i"), F.count_if(F.expr("f = 1 and o = 0")).alias("e"))
    return n.select(F.stack(F.lit(3), F.lit("union"), "u", F.lit("intersect"), "i", F.lit("except"), "e").alias("op", "n"))


@query("""
with u as (select c_custkey as key, c_nationkey as nationkey, c_acctbal as acctbal, c_mktsegment as segment, 'customer' as kind from customer union all select s_suppkey, s_nationkey, s_acctbal, null, 'supplier' from supplier)
select kind, nationkey, coalesce(segment, '') as segment, count(*) as n, cast(round(sum(acctbal), 2) as double) as balance from u group by 1, 2, 3""")
def union_by_name_fill(spark: SparkSession, d: str) -> DataFrame:
    """Customers and suppliers on end by column name; columns one lacks are null."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nationkey"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"), F.lit("customer").alias("kind"))
    s = table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nationkey"), F.col("s_acctbal").alias("acctbal"))
    return c.unionByName(s, allowMissingColumns=True).groupBy("kind", "nationkey", F.coalesce("segment", F.lit("")).alias("segment")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("acctbal"), 2).alias("balance"))


@query("""
with o as (select year(o_orderdate) as y, o_totalprice from orders), r as (select * from o where y <> 2000 union all select y, o_totalprice * 2 from o where y = 2000)
select y, count(*) as n, cast(round(sum(o_totalprice), 2) as double) as total from r group by y""")
def replace_version(spark: SparkSession, d: str) -> DataFrame:
    """The orders of one year replaced by a candidate's."""
    o = table(spark, d, "orders").select(F.year("o_orderdate").cast("long").alias("y"), "o_totalprice")
    candidate = o.filter("y = 2000").withColumn("o_totalprice", F.col("o_totalprice") * 2)
    return diff.replace_version(o, candidate, "y").groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""
with f as (select split, 'a' as side, case when difficulty = 'easy' then 'MATCH' else 'NO_MATCH' end as p, case_id, reference_membership as truth from identity_e2e_v6_72),
one as (select case_id, min(split) as split, min(reference_membership) as truth, min(case when difficulty = 'easy' then 'MATCH' else 'NO_MATCH' end) as pred_a, min(case when challenge_class like '%salt%' then 'MATCH' else 'NO_MATCH' end) as pred_b from identity_e2e_v6_72 group by case_id)
select split, pred_a, pred_b, count(*) as n from one group by 1, 2, 3""")
def paired_self_join(spark: SparkSession, d: str) -> DataFrame:
    """Two systems' answers side by side: one aggregation instead of a self-join."""
    e = table(spark, d, "identity_e2e_v6_72")
    systems = e.select("case_id", "split", F.explode(F.array(F.struct(F.lit("a").alias("system"), F.when(F.col("difficulty") == "easy", "MATCH").otherwise("NO_MATCH").alias("answer")), F.struct(F.lit("b").alias("system"), F.when(F.col("challenge_class").contains("salt"), "MATCH").otherwise("NO_MATCH").alias("answer")))).alias("s")).select("case_id", "split", "s.*")
    answer = lambda s: F.min(F.when(F.col("system") == s, F.col("answer"))).alias(f"pred_{s}")
    return systems.groupBy("case_id").agg(F.min("split").alias("split"), answer("a"), answer("b")).groupBy("split", "pred_a", "pred_b").agg(F.count(F.lit(1)).alias("n"))


@query("""
with m as (select distinct l_orderkey, p_type from lineitem join part on l_partkey = p_partkey where p_size > 40)
select o_orderkey, count(p_type) as n_targets, case when count(p_type) = 0 then 'NOT_FOUND' when count(p_type) = 1 then 'FOUND:' || min(p_type) else 'MULTI_TARGET' end as gold from orders left join m on o_orderkey = l_orderkey group by 1""")
def gold_derivation(spark: SparkSession, d: str) -> DataFrame:
    """None, one or many targets of each order."""
    big = table(spark, d, "part").filter("p_size > 40").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    m = table(spark, d, "lineitem").join(big, "l_partkey").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_distinct("p_type").alias("n"), F.min("p_type").alias("one"))
    n = F.coalesce("n", F.lit(0))
    return table(spark, d, "orders").select("o_orderkey").join(m, "o_orderkey", "left").select("o_orderkey", n.cast("long").alias("n_targets"), F.when(n == 0, "NOT_FOUND").when(n == 1, F.concat(F.lit("FOUND:"), "one")).otherwise("MULTI_TARGET").alias("gold"))


@query("""
with c as (select rule_id, threshold_pct, f, greatest(1e-6, least(100.0, threshold_pct * f)) as conc, row_number() over (order by rule_id) % 3 as kind from group_rules cross join (values (0.8::double), (1.2::double)) v(f))
select rule_id, f as factor, round(conc, 6) as conc, conc >= threshold_pct as gold, case when kind = 0 then 'REVIEW' when conc >= threshold_pct then 'MATCH' else 'NO_MATCH' end as system from
 (select rule_id, threshold_pct, f, conc, length(rule_id) % 3 as kind from c)""")
def challenge_grid(spark: SparkSession, d: str) -> DataFrame:
    """Two cases a rule, below and above its limit, with the gold answer and a system's."""
    g = table(spark, d, "group_rules").select("rule_id", "threshold_pct", F.explode(F.array(F.lit(0.8), F.lit(1.2))).alias("factor"))
    g = g.withColumn("c", F.greatest(F.lit(1e-6), F.least(F.lit(100.0), F.col("threshold_pct") * F.col("factor"))))
    gold = F.col("c") >= F.col("threshold_pct")
    return g.select("rule_id", "factor", F.round("c", 6).alias("conc"), gold.alias("gold"), F.when(F.length("rule_id") % 3 == 0, "REVIEW").when(gold, "MATCH").otherwise("NO_MATCH").alias("system"))
