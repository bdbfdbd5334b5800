"""Text classes, votes, metrics, versions, samples and checks over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import conditions as C
from ..operators import metrics, quality, votes, windows
from ..session import table
from .registry import Registry

R = Registry()
query = R.query
QUERIES, SQL = R.queries, R.sql

_CASES = """with c as (select case_id, min(split) as split, min(source) as source, min(coalesce(reference_membership, '')) as m, min(coalesce(difficulty, '')) as difficulty, min(coalesce(challenge_class, '')) as cl from identity_e2e_v6_72 group by case_id),
e as (select case_id, split, source, case when upper(m) = 'MATCH' then 'MATCH' else 'NO_MATCH' end as truth, case when difficulty = 'hard' then 'REVIEW' when cl like '%salt%' then 'MATCH' else 'NO_MATCH' end as pred from c)"""


def _cases(spark: SparkSession, d: str) -> DataFrame:
    """Identity cases with their truth and a rule's answer, which leaves hard ones for review."""
    low = lambda c: F.min(F.coalesce(c, F.lit(""))).alias(c)
    c = table(spark, d, "identity_e2e_v6_72").groupBy("case_id").agg(F.min("split").alias("split"), F.min("source").alias("source"), low("reference_membership"), low("difficulty"), low("challenge_class"))
    truth = F.when(F.upper("reference_membership") == "MATCH", "MATCH").otherwise("NO_MATCH")
    pred = F.when(F.col("difficulty") == "hard", "REVIEW").when(F.col("challenge_class").contains("salt"), "MATCH").otherwise("NO_MATCH")
    return c.select("case_id", "split", "source", truth.alias("truth"), pred.alias("pred"))


_CELLS = """, k as (select split, count(*) filter (truth = 'MATCH' and pred = 'MATCH') as tp, count(*) filter (truth = 'NO_MATCH' and pred = 'MATCH') as fp, count(*) filter (truth = 'MATCH' and pred = 'NO_MATCH') as fn,
count(*) filter (truth = 'NO_MATCH' and pred = 'NO_MATCH') as tn, count(*) filter (pred = 'REVIEW') as n_review, count(*) filter (pred = 'REVIEW' and truth = 'MATCH') as review_match, count(*) as n_total from e group by split)"""


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return metrics.cells(_cases(spark, d), F.col("truth"), F.col("pred"), ["split"])


@query(f"""{_CASES}{_CELLS} select split, tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 6) as precision, round(tp / nullif(tp + fn, 0), 6) as recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) as f1, round((tp + tn) / nullif(tp + fp + fn + tn, 0), 6) as accuracy from k""")
def confusion_binary(spark: SparkSession, d: str) -> DataFrame:
    return metrics.binary_rates(_cells(spark, d), ["split"])


@query(f"""{_CASES}{_CELLS} select split, tp + fp + fn + tn as n_decided, round((tp + fp + fn + tn) / n_total, 6) as coverage, round((tp + tn) / nullif(tp + fp + fn + tn, 0), 6) as selective_accuracy, round(n_review / n_total, 6) as review_share from k""")
def confusion_selective(spark: SparkSession, d: str) -> DataFrame:
    return metrics.selective_rates(_cells(spark, d), ["split"])


@query(f"""{_CASES}{_CELLS}, r as (select *, tp / nullif(tp + fn, 0) as rec, tn / nullif(tn + fp, 0) as spec from k)
select split, round(rec, 6) as recall, round(spec, 6) as specificity, round((coalesce(rec, spec) + coalesce(spec, rec)) / 2, 6) as balanced_accuracy, round((tp + tn) / n_total, 6) as overall_correct from r""")
def confusion_balanced(spark: SparkSession, d: str) -> DataFrame:
    return metrics.balanced_rates(_cells(spark, d), ["split"])


@query(f"""{_CASES}{_CELLS} select split, fn + review_match as fn_all, coalesce(round(tp / nullif(tp + fp, 0), 6), 0) as precision, coalesce(round(tp / nullif(tp + fn + review_match, 0), 6), 0) as recall, round((tp + tn) / n_total, 6) as accuracy, round(n_review / n_total, 6) as review_rate from k""")
def confusion_strict(spark: SparkSession, d: str) -> DataFrame:
    return metrics.strict_rates(_cells(spark, d), ["split"])


@query(f"""{_CASES}, t as (select split, case when truth = 'MATCH' then 'T:' || source else 'NOT_FOUND' end as truth, case when pred = 'REVIEW' then 'REVIEW' when pred = 'MATCH' then 'T:' || case when length(case_id) % 2 = 0 or right(case_id, 1) = '7' then source else 'other' end else 'NOT_FOUND' end as pred from e),
k as (select split, count(*) as n_total, count(*) filter (truth = pred and pred <> 'REVIEW') as n_correct, count(*) filter (pred not in ('NOT_FOUND', 'REVIEW') and truth <> 'NOT_FOUND' and truth <> pred) as wrong_target, count(*) filter (pred = 'NOT_FOUND' and truth <> 'NOT_FOUND') as false_not_found,
count(*) filter (pred not in ('NOT_FOUND', 'REVIEW') and truth = 'NOT_FOUND') as false_found, count(*) filter (pred = 'NOT_FOUND' and truth = 'NOT_FOUND') as nn, count(*) filter (pred = 'NOT_FOUND') as pn, count(*) filter (truth = 'NOT_FOUND') as tn from t group by split)
select split, n_total, n_correct, wrong_target, false_not_found, false_found, round(n_correct / n_total, 6) as accuracy, round(nn / nullif(pn, 0), 6) as not_found_precision, round(nn / nullif(tn, 0), 6) as not_found_recall from k""")
def confusion_retrieval(spark: SparkSession, d: str) -> DataFrame:
    e = _cases(spark, d)
    truth = F.when(F.col("truth") == "MATCH", F.concat(F.lit("T:"), "source")).otherwise("NOT_FOUND")
    guess = F.when((F.length("case_id") % 2 == 0) | F.col("case_id").endswith("7"), F.col("source")).otherwise("other")
    pred = F.when(F.col("pred") == "REVIEW", "REVIEW").when(F.col("pred") == "MATCH", F.concat(F.lit("T:"), guess)).otherwise("NOT_FOUND")
    return metrics.retrieval_rates(e, truth, pred, ["split"])


_LANG = """with t as (select lower(lang) as truth, case when text is null then '' when regexp_matches(text, '[가-힣]') then 'ko' when regexp_matches(text, ' (und|der|wurde) ') then 'de' else 'en' end as pred from documents where lang is not null),
ok as (select * from t where truth <> '' and pred <> ''), b as (select truth, pred, count(*) as n from ok group by 1, 2),
l as (select label, sum(tp) as tp, sum(t) as t, sum(p) as p from (select truth as label, case when truth = pred then n else 0 end as tp, n as t, 0 as p from b union all select pred, 0, 0, n from b) group by 1)"""


def _languages(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    guess = F.when(text.isNull(), "").when(text.rlike("[가-힣]"), "ko").when(text.rlike(" (und|der|wurde) "), "de").otherwise("en")
    return table(spark, d, "documents").filter("lang is not null").select(F.lower("lang").alias("truth"), guess.alias("pred"))


@query(f"""{_LANG} select cast(sum(t) as bigint) as n, round(cast(sum(tp) as double) / sum(t), 6) as accuracy, round(avg(coalesce(2.0 * cast(tp as double) / nullif(cast(t + p as double), 0), 0)), 6) as macro_f1, count(*) as n_labels from l""")
def multiclass_macro_f1(spark: SparkSession, d: str) -> DataFrame:
    """A guess of the language against the given one."""
    return metrics.macro_f1(_languages(spark, d), "truth", "pred")


@query(f"""{_LANG}, a as (select cast(sum(t) as double) as n, cast(sum(tp) as double) as agree, sum(cast(t as double) * cast(p as double)) as pairs from l)
select cast(n as bigint) as n, round(agree / n, 6) as observed, round(pairs / (n * n), 6) as expected, case when abs(1 - pairs / (n * n)) > 1e-12 then round((agree / n - pairs / (n * n)) / (1 - pairs / (n * n)), 6) end as kappa from a""")
def cohen_kappa(spark: SparkSession, d: str) -> DataFrame:
    return metrics.kappa(_languages(spark, d), "truth", "pred")


@query(f"""{_CASES}, k as (select split, count(*) filter (truth = pred and not (truth = 'MATCH' and length(source) % 2 = 0)) as only_a, count(*) filter (truth <> pred and (truth = 'MATCH' and length(source) % 2 = 0)) as only_b from e group by split),
s as (select split, only_a, only_b, only_a + only_b as n, unnest(range(0, least(only_a, only_b) + 1)) as i from k)
select split, only_a, only_b, round(least(1.0, 2 * sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2.0)))), 6) as p_value from s group by 1, 2, 3""")
def mcnemar_exact(spark: SparkSession, d: str) -> DataFrame:
    """Paired answers of two systems on the same cases: exact test of the discordant ones."""
    right_a = F.col("truth") == F.col("pred")
    right_b = (F.col("truth") == "MATCH") & (F.length("source") % 2 == 0)
    k = _cases(spark, d).groupBy("split").agg(F.count_if(right_a & ~right_b).alias("only_a"), F.count_if(~right_a & right_b).alias("only_b"))
    return k.select("split", "only_a", "only_b", F.round(metrics.mcnemar_p(F.col("only_a"), F.col("only_b")), 6).alias("p_value"))


@query("""
with t as (select source, count(*) as n, count(*) filter (text is null or trim(text, ' ') = '') as k from documents group by 1), z as (select *, 1.959963984540054 as z, k / n as p from t)
select source, k, n, round(greatest(0, least(1, (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n))), 6) as low, round(greatest(0, least(1, (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n))), 6) as high from z""")
def wilson_ci(spark: SparkSession, d: str) -> DataFrame:
    """Share of empty texts by source, with its interval."""
    k = table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("text").isNull() | (F.trim("text") == "")).alias("k"))
    low, high = metrics.wilson(F.col("k"), F.col("n"))
    return k.select("source", "k", "n", low.alias("low"), high.alias("high"))


@query("""
select coalesce(source, '') as source, count(*) as n, round(count(*) / (select count(*) from documents), 6) as share from documents group by 1
union all select 'TOTAL', count(*), 1.0 from documents""")
def freq_share_total(spark: SparkSession, d: str) -> DataFrame:
    return metrics.with_total(table(spark, d, "documents"), "source")


@query("""
select l_returnflag, coalesce(cast(round(sum(l_quantity) filter (l_linestatus = 'F'), 2) as double), 0) as f, coalesce(cast(round(sum(l_quantity) filter (l_linestatus = 'O'), 2) as double), 0) as o from lineitem group by 1""")
def crosstab_pivot(spark: SparkSession, d: str) -> DataFrame:
    """A pivot over values named beforehand, so that no pass is needed to find them."""
    p = table(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.round(F.sum("l_quantity"), 2))
    return p.fillna(0.0).withColumnsRenamed({"F": "f", "O": "o"})


@query("""
with r as (select event_type, cast(ts as date) as day, avg(value) as v from events group by 1, 2)
select event_type, count(*) as n_repeats, round(avg(v), 6) as mean, round(coalesce(stddev_samp(v), 0), 6) as std from r group by 1""")
def repeat_mean_std(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))
    return r.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_repeats"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("v"), F.lit(0.0)), 6).alias("std"))


@query("""
with t as (select source, coalesce(lower(lang), '') as lang, count(*) as n from documents group by 1, 2)
select source, lang, n, round(n / sum(n) over (partition by source), 6) as share from t""")
def within_group_share(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "documents").groupBy("source", F.coalesce(F.lower("lang"), F.lit("")).alias("lang")).agg(F.count(F.lit(1)).alias("n"))
    total = per.groupBy("source").agg(F.sum("n").alias("t"))
    return per.join(total, "source").select("source", "lang", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"))


_VOTES = "case event_type when 'purchase' then 'MATCH' when 'signup' then 'MATCH' when 'view' then 'NO_MATCH' when 'click' then 'NO_MATCH' else 'OTHER' end"


def _vote():
    e = F.col("event_type")
    return F.when(e.isin("purchase", "signup"), "MATCH").when(e.isin("view", "click"), "NO_MATCH").otherwise("OTHER")


@query(f"""
with v as (select user_id, case when {_VOTES} = 'OTHER' then 'REVIEW' else {_VOTES} end as v from events), c as (select user_id, v, count(*) as n from v group by 1, 2)
select user_id, coalesce(max(v) filter (n * 2 > t), 'REVIEW') as decision, max(t) as n_votes from (select *, cast(sum(n) over (partition by user_id) as bigint) as t from c) group by 1""")
def majority_vote(spark: SparkSession, d: str) -> DataFrame:
    """More than half of a user's votes, else review; invalid votes count as review."""
    return votes.majority(table(spark, d, "events"), ["user_id"], _vote(), ["MATCH", "NO_MATCH"])


@query(f"""
with v as (select user_id, case when {_VOTES} = 'OTHER' then 'REVIEW' when {_VOTES} = 'MATCH' then 'FOUND:' || event_type else 'NOT_FOUND' end as v from events), c as (select user_id, v, count(*) as n from v group by 1, 2)
select user_id, case when max(t) = 9 then coalesce(max(v) filter (n * 2 > t), 'REVIEW') else 'REVIEW' end as decision, max(t) as n_votes from (select *, cast(sum(n) over (partition by user_id) as bigint) as t from c) group by 1""")
def multi_target_vote(spark: SparkSession, d: str) -> DataFrame:
    """Votes on targets; only users with all nine answers are decided."""
    v = F.when(_vote() == "MATCH", F.concat(F.lit("FOUND:"), "event_type")).when(_vote() == "NO_MATCH", "NOT_FOUND").otherwise("REVIEW")
    return votes.majority(table(spark, d, "events"), ["user_id"], v, ["FOUND:purchase", "FOUND:signup", "NOT_FOUND"], repeats=9)


@query("""
select user_id, count(distinct event_type) as n_strata from events group by 1 having count(distinct event_type) = (select count(distinct event_type) from events)""")
def relational_division(spark: SparkSession, d: str) -> DataFrame:
    return votes.in_every(table(spark, d, "events"), "user_id", "event_type")


@query("""
with r as (select o_custkey, o_orderpriority as p, case left(o_orderpriority, 1) when '1' then 5 when '2' then 4 when '3' then 3 when '4' then 2 else 1 end as k from orders)
select o_custkey, max(p order by k, p) as worst, kinds from (select o_custkey, last(p order by k, p) as p, 0 as k, array_to_string(list_sort(list(distinct p)), ';') as kinds from r group by 1) group by o_custkey, kinds""")
def worst_route(spark: SparkSession, d: str) -> DataFrame:
    """The highest ranked priority of each customer's orders controls."""
    first = F.substring("o_orderpriority", 1, 1)
    return votes.worst(table(spark, d, "orders"), "o_custkey", C.route_rank(first, {"1": 5, "2": 4, "3": 3, "4": 2}, 1), "o_orderpriority")


@query("""
with v as (select distinct year(o_orderdate) as y from orders order by 1 desc limit 2), r as (select y, row_number() over (order by y desc) as version_rank from v)
select cast(version_rank as integer) as version_rank, o_orderstatus, count(*) as n from orders join r on year(o_orderdate) = y group by 1, 2""")
def latest_two_versions(spark: SparkSession, d: str) -> DataFrame:
    o = windows.latest(table(spark, d, "orders").select("o_orderdate", "o_orderstatus"), F.year("o_orderdate"), 2)
    return o.groupBy("version_rank", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("""
with k as (select *, max(case when o_orderstatus = 'P' then 1 else 0 end) over (partition by o_custkey) as has_p from orders) select o_custkey, count(*) as n, cast(round(sum(o_totalprice), 2) as double) as total from k where o_orderstatus = 'P' or has_p = 0 group by 1""")
def guard_filter_fallback(spark: SparkSession, d: str) -> DataFrame:
    """A customer's orders of one status, or all of them if there is none."""
    o = windows.filter_or_all(table(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_totalprice"), "o_custkey", F.col("o_orderstatus") == "P")
    return o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


_NORM = "trim(regexp_replace(lower(text), '[^a-z0-9가-힣äöüß]+', ' ', 'g'), ' ')"


@query(f"""
with t as (select sha256({_NORM}) as text_key, case source when 'notice_feed' then 1 when 'sds_archive' then 2 else 3 end as priority, doc_id, source from documents where text is not null),
r as (select *, row_number() over (partition by text_key order by priority, doc_id) as rn, count(*) over (partition by text_key) as n_copies from t) select text_key, priority, doc_id, source, n_copies from r where rn = 1""")
def priority_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """The first of equal texts, by the source's priority and id."""
    norm = F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9가-힣äöüß]+", " "))
    t = table(spark, d, "documents").filter("text is not null").select(F.sha2(norm, 256).alias("text_key"), F.when(F.col("source") == "notice_feed", 1).when(F.col("source") == "sds_archive", 2).otherwise(3).alias("priority"), "doc_id", "source")
    return windows.keep_first(t, ["text_key"], ["priority", "doc_id"], ["source"])


@query("""
select event_id, cast(sum(case when event_type = 'signup' then 1 else 0 end) over w as bigint) as segment, last_value(case when event_type = 'purchase' then value end ignore nulls) over w as carried from events window w as (partition by user_id order by ts, event_id rows between unbounded preceding and current row)""")
def forward_fill_segment(spark: SparkSession, d: str) -> DataFrame:
    """Segments that a signup starts, and the last purchase carried on."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value")
    return windows.carried(e, "user_id", ["ts", "event_id"], F.col("event_type") == "signup", F.when(F.col("event_type") == "purchase", F.col("value"))).select("event_id", "segment", "carried")


@query("""
with b as (select *, row_number() over (partition by p_type, p_brand order by p_retailprice desc, p_partkey) as rb from part), t as (select *, row_number() over (partition by p_type order by p_retailprice desc, p_partkey) as place from b where rb = 1)
select p_type, p_brand, p_partkey, cast(place as integer) as place from t where place <= 3""")
def topn_distinct_casebook(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_type", "p_brand", "p_partkey", "p_retailprice")
    return windows.top_distinct(p, "p_type", "p_brand", [F.desc("p_retailprice"), F.asc("p_partkey")], 3).select("p_type", "p_brand", "p_partkey", "place")


@query("""
with s as (select l_suppkey, p_brand, min(l_orderkey) as first_key from lineitem join part on l_partkey = p_partkey group by 1, 2), r as (select *, row_number() over (partition by l_suppkey order by first_key, p_brand) as k from s)
select l_suppkey, string_agg(p_brand, '; ' order by first_key, p_brand) filter (k <= 6) as brands, count(*) as n_brands from r group by 1""")
def composite_summary(spark: SparkSession, d: str) -> DataFrame:
    """The first six distinct brands of each supplier, in the order they came."""
    s = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).groupBy("l_suppkey", "p_brand").agg(F.min("l_orderkey").alias("k"))
    return windows.first_distinct(s, "l_suppkey", "p_brand", "k", 6, "; ").select("l_suppkey", F.col("joined").alias("brands"), F.col("n_distinct").alias("n_brands"))


@query("""
with p as (select case_id, m, sha256('s20260910' || case_id) as h from (select case_id, min(reference_membership) as m from group_membership_v1_50 group by 1) where m is not null), n as (select round(count(*) * 0.5) as n from p where m = 'MATCH'),
r as (select *, row_number() over (order by h, case_id) as k from p where m <> 'MATCH')
select case_id, m from p where m = 'MATCH' union all select case_id, m from r where k <= (select n from n)""")
def balanced_sample(spark: SparkSession, d: str) -> DataFrame:
    """All matches and half as many others, chosen by a seeded hash."""
    p = table(spark, d, "group_membership_v1_50").groupBy("case_id").agg(F.min("reference_membership").alias("m")).filter("m is not null")
    return windows.balanced(p, F.col("m") == "MATCH", "case_id", "s20260910", 0.5)


@query("""
select o_orderkey, o_custkey, case o_orderstatus when 'P' then 1 when 'O' then 2 when 'F' then 3 else 9 end as priority from orders order by priority, o_custkey, o_orderkey limit 100""")
def alert_priority_sort(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred alerts by priority; a top-k, so no full sort."""
    rank = C.route_rank(F.col("o_orderstatus"), {"P": 1, "O": 2, "F": 3})
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", rank.alias("priority")).orderBy("priority", "o_custkey", "o_orderkey").limit(100)


@query("""
with k as (select 'orders_unique' as check_name, count(*) as n_rows, count(*) filter (n > 1) as n_bad from (select count(*) as n from orders group by o_orderkey)
union all select 'discount_in_range', count(*), count(*) filter (l_discount < 0 or l_discount > 0.09) from lineitem
union all select 'one_label_per_case', count(*), count(*) filter (n <> 1) from (select count(distinct nullif(trim(reference_membership, ' '), '')) as n from broad_salt_validation_cases group by case_id)
union all select 'rules_have_scope', count(*), count(*) filter (coalesce(trim(scope_text, ' '), '') = '') from group_rules)
select check_name, n_rows, n_bad, case when n_bad = 0 then 'PASS' else 'FAIL' end as status from k""")
def quality_checks(spark: SparkSession, d: str) -> DataFrame:
    """One row per named check."""
    return quality.all_checks(
        [
            quality.unique(table(spark, d, "orders"), "orders_unique", ["o_orderkey"]),
            quality.check(table(spark, d, "lineitem"), "discount_in_range", (F.col("l_discount") < 0) | (F.col("l_discount") > 0.09)),
            quality.one_value(table(spark, d, "broad_salt_validation_cases"), "one_label_per_case", "case_id", "reference_membership"),
            quality.check(table(spark, d, "group_rules"), "rules_have_scope", F.coalesce(F.trim("scope_text"), F.lit("")) == ""),
        ]
    )


@query("""
with x as (select doc_id, unnest(list_distinct(regexp_extract_all(text, '(?:^|[^0-9])(\\d{2,7}-\\d{2}-\\d)(?:[^0-9]|$)', 1))) as number from documents where text is not null),
g as (select doc_id, number, replace(number, '-', '') as dg from x), s as (select *, reverse(substr(dg, 1, length(dg) - 1)) as b from g)
select doc_id, number, (list_sum(list_transform(range(1, length(b) + 1), lambda i: i * cast(substr(b, i, 1) as integer))) % 10) = cast(right(dg, 1) as integer) as valid from s""".replace("\\\\", "\\"))
def number_extract(spark: SparkSession, d: str) -> DataFrame:
    """Registry numbers of each text, each once, and whether their check digit is right."""
    x = table(spark, d, "documents").filter("text is not null").select("doc_id", F.explode(C.numbers_in(F.col("text"))).alias("number"))
    return x.select("doc_id", "number", C.check_digit(F.col("number")).alias("valid"))


@query("""select doc_id, case when length(text) <= 300 then text else substr(text, 1, 200) || ' ... ' || right(text, 100) end as compact from documents where text is not null""")
def head_tail_compact(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text is not null").select("doc_id", C.head_and_tail(F.col("text"), 300, least_tail=100).alias("compact"))


@query("""select case_id, 'API_' || substr(sha256(concat_ws('|', trim(regexp_replace(coalesce(candidate_cas, ''), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), ' '), trim(regexp_replace(coalesce(candidate_name, ''), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), ' '))), 1, 16) as stable_id from group_membership_v1_50""".replace("\\\\", "\\"))
def stable_hash_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "group_membership_v1_50").select("case_id", C.stable_id("API_", [F.col("candidate_cas"), F.col("candidate_name")]).alias("stable_id"))


@query("""select event_type, cast(json_extract(props, '$.k') as bigint) as k, count(*) as n from events group by 1, 2""")
def json_extract_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("""
with p as (select doc_id, list_transform(regexp_extract_all(text, '(\\d+(?:\\.\\d+)?)\\s*(?:%|퍼센트)', 1), lambda x: cast(x as double)) as v, regexp_matches(text, '(?i)guidance value|기준 농도|grenzwert') as limited, regexp_matches(text, '(?i)\\b\\d+ (days|tage)\\b|\\d+일') as timed from documents where text is not null)
select doc_id, len(v)::int as n_percents, list_min(v) as least, list_max(v) as most, concat_ws(';', case when len(v) > 0 then 'threshold' end, case when limited then 'limit' end, case when timed then 'temporal' end) as dimensions from p""".replace("\\\\", "\\"))
def condition_flags(spark: SparkSession, d: str) -> DataFrame:
    """Percent conditions and applicability dimensions of each text."""
    t = F.col("text")
    x = table(spark, d, "documents").filter("text is not null").select("doc_id", C.percents(t).alias("v"), t.rlike("(?i)guidance value|기준 농도|grenzwert").alias("limited"), t.rlike(r"(?i)\b\d+ (days|tage)\b|\d+일").alias("timed"))
    dims = C.joined_labels({"threshold": F.size("v") > 0, "limit": F.col("limited"), "temporal": F.col("timed")})
    return x.select("doc_id", F.size("v").alias("n_percents"), F.array_min("v").alias("least"), F.array_max("v").alias("most"), dims.alias("dimensions"))


@query("""
select source_verified as word, lower(trim(coalesce(source_verified, ''), ' ')) in ('1','true','yes','y','validated','approved','예') as approval, lower(trim(coalesce(source_verified, ''), ' ')) in ('1','true','yes','y','예','o') as short,
lower(trim(coalesce(source_verified, ''), ' ')) in ('1','true','yes','y','예','맞음') as answer, case when lower(trim(coalesce(source_verified, ''), ' ')) in ('nan','none','null','<na>') then '' else trim(coalesce(source_verified, ''), ' ') end as cleaned, count(*) as n
from (select source_verified from broad_salt_rules union all select source_verified from broad_salt_rules_curated_13) group by all""")
def truth_words(spark: SparkSession, d: str) -> DataFrame:
    """Words for true under three dialects, and cleaned ones."""
    w = F.col("source_verified")
    both = table(spark, d, "broad_salt_rules").select(w).unionByName(table(spark, d, "broad_salt_rules_curated_13").select(w))
    return both.groupBy(w.alias("word"), C.is_true(w).alias("approval"), C.is_true(w, "short").alias("short"), C.is_true(w, "answer").alias("answer"), C.clean(w, "wide").alias("cleaned")).agg(F.count(F.lit(1)).alias("n"))


@query("""
select label, count(*) as n_vectors, cast(round(avg(list_sum(list_transform(embedding, lambda x: cast(x as double) * cast(x as double)))), 4) as double) as mean_norm from embeddings group by 1""")
def embedding_norms(spark: SparkSession, d: str) -> DataFrame:
    """Mean squared length of the vectors of each label."""
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return table(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n_vectors"), F.round(F.avg(norm), 4).alias("mean_norm"))


@query("""
with c as (select user_id, count(*) filter (event_type = 'click') as full_calls, count(*) filter (event_type = 'click' and value > 50) as hybrid_calls from events group by 1)
select count(*) as n_users, cast(sum(full_calls) as bigint) as full_calls, cast(sum(hybrid_calls) as bigint) as hybrid_calls, round(1 - cast(sum(hybrid_calls) as double) / sum(full_calls), 6) as reduction from c""")
def call_reduction(spark: SparkSession, d: str) -> DataFrame:
    """Calls that a gate saves."""
    e = table(spark, d, "events")
    c = e.groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("f"), F.count_if((F.col("event_type") == "click") & (F.col("value") > 50)).alias("h"))
    return c.agg(F.count(F.lit(1)).alias("n_users"), F.sum("f").alias("full_calls"), F.sum("h").alias("hybrid_calls"), F.round(1 - F.sum("h") / F.sum("f"), 6).alias("reduction"))
