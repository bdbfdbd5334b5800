"""Scope classes, gates, model answers, rule fields and governance over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers, rules, scope
from ..functions import conditions as C
from ..operators import gates, metrics, quality, screen, votes, windows
from ..operators import governance as G
from ..session import table
from ..sources import grids, tables
from .registry import Registry

R = Registry()
query = R.query
QUERIES, SQL = R.queries, R.sql


def _re2(pattern: str) -> tuple[str, int]:
    """A pattern for the other engine, its phrase in group 1, its word boundaries written out."""
    p = pattern.replace(r"\s", r"[\s\p{Z}]").replace(r"[[\s\p{Z}],", r"[\s\p{Z},")
    lead, trail = p.startswith(r"\b"), p.endswith(r"\b") and not p.endswith(r"\\b")
    core = p[2 if lead else 0 : -2 if trail else None].replace(r"\b", "")
    edge = r"[^\p{L}\p{N}_]"
    return f"{f'(?:^|{edge})' if lead else ''}({core}){f'(?:{edge}|$)' if trail else ''}"


def _sql_words(patterns: list[str]) -> str:
    return "(?i)" + "|".join(f"(?:{_re2(p)})" for p in patterns)


def _quoted(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def _sql_says(c: str, patterns: list[str]) -> str:
    return f"regexp_matches({c}, {_quoted(_sql_words(patterns))})"


def _sql_phrase(c: str, patterns: list[str]) -> str:
    parts = " || ".join(f"regexp_extract({c}, {_quoted(_sql_words(patterns))}, {i})" for i in range(1, len(patterns) + 1))
    return rf"trim(regexp_replace({parts}, '[\s\p{{Z}}]+', ' ', 'g'), ' ')"


_HAS = r"regexp_matches(t, '(?:^|[^0-9])\d{2,7}-\d{2}-\d(?:[^0-9]|$)')"


def _classify_sql() -> str:
    S = scope
    rows = [("true", S.EXCLUSION, "EXPLICIT_EXCEPTION", "EXPLICIT_EXCEPTION_CLAUSE")]
    for label, p, reason in [("REACTION_PRODUCT", S.REACTION_PRODUCT, "REACTION_PRODUCT"), ("MIXTURE_OR_UVCB", S.MIXTURE_UVCB, "MIXTURE_OR_UVCB"), ("BROAD_SALT", S.SALT_FAMILY, "SALT_FAMILY"), ("DERIVATIVE_FAMILY", S.GENERIC_DERIVATIVE, "DERIVATIVE_FAMILY"), ("COMPOUND_GROUP", S.GENERIC_COMPOUND, "COMPOUND_GROUP"), ("STRUCTURAL_RANGE", S.STRUCTURAL_RANGE, "STRUCTURAL_RANGE")]:
        rows.append(("not has", p, label, f"NO_DIRECT_CAS;NO_DIRECT_CAS_{reason}"))
    rows.append(("not has", None, "NO_DIRECT_CAS_OTHER", "NO_DIRECT_CAS"))
    rows += [("true", S.BROAD_SALT_REL, "BROAD_SALT", "DIRECT_CAS_PLUS_EXPLICIT_BROAD_SALT_SCOPE"), ("true", S.COMPOUND_REL, "COMPOUND_GROUP", "DIRECT_CAS_PLUS_EXPLICIT_COMPOUND_FAMILY_SCOPE"), ("true", S.DERIVATIVE_REL, "DERIVATIVE_FAMILY", "DIRECT_CAS_PLUS_EXPLICIT_DERIVATIVE_FAMILY_SCOPE")]
    when = lambda i: " ".join(f"when {c}{' and ' + _sql_says('t', p) if p else ''} then {_sql_phrase('t', p) if i == 2 and p else _quoted('' if i == 2 else (label, reason)[i])}" for c, p, label, reason in rows)
    marks = [("SALT_WORD", S.SALT_FAMILY), ("REACTION_PRODUCT_WORD", S.REACTION_PRODUCT), ("MIXTURE_UVCB_WORD", S.MIXTURE_UVCB), ("DERIVATIVE_WORD", S.SPECIFIC_DERIVATIVE), ("COMPOUND_WORD", S.SPECIFIC_COMPOUND), ("STRUCTURAL_RANGE", S.STRUCTURAL_RANGE)]
    plain = "concat_ws(';', 'DIRECT_CAS_ASSIGNED_AND_NO_EXPLICIT_SCOPE_EXTENSION', " + ", ".join(f"case when {_sql_says('t', p)} then '{w}_IN_SPECIFIC_NAME' end" for w, p in marks) + ")"
    # no text of these tables names a list of members, whose cases are tested on their own
    return f"""with d as (select doc_id, trim(coalesce(text, ''), ' ') as t from documents), h as (select *, {_HAS} as has from d)
select doc_id, case {when(0)} else 'DIRECT_CAS_ONLY' end as scope, case {when(0)} end is not null as positive, case {when(1)} else {plain} end as reasons, case {when(2)} else '' end as evidence from h"""


@query(_classify_sql())
def scope_classifier(spark: SparkSession, d: str) -> DataFrame:
    """Scope class of each text with its reasons and the words that show it."""
    t = F.coalesce("text", F.lit(""))
    docs = table(spark, d, "documents")
    return docs.select("doc_id", scope.classified(t, F.lit(""), t.rlike(C.NUMBER_PATTERN)).alias("s")).select("doc_id", "s.*")


_SEMANTIC = f"""case when {_sql_says('t', scope.BROAD_SALT_PATTERNS)} then 'BROAD_SALT_SCOPE' when {_sql_says('t', scope.MIXTURE_PATTERNS)} then 'MIXTURE_OR_REACTION' when {_sql_says('t', scope.STRUCTURAL_RANGE_PATTERNS)} then 'STRUCTURAL_RANGE'
 when has then 'SINGLE_OR_DIRECT_CAS' when {_sql_says('t', scope.GENERIC_GROUP_PATTERNS)} then 'GENERIC_GROUP_OR_DERIVATIVE' when {_sql_says('t', scope.SALT_FAMILY_PATTERNS)} then 'SALT_FAMILY' else 'OTHER' end"""
_SEEDS = f"with t as (select seed_id, coalesce(regulatory_scope_text, '') as t, regexp_matches(coalesce(candidate_cas, ''), '(?:^|[^0-9])\\d{{2,7}}-\\d{{2}}-\\d(?:[^0-9]|$)') as has from chemical_group_candidates_seed)".replace("\\\\", "\\")


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "chemical_group_candidates_seed")
    return s.select("seed_id", F.coalesce("regulatory_scope_text", F.lit("")).alias("t"), F.coalesce("candidate_cas", F.lit("")).rlike(C.NUMBER_PATTERN).alias("has"))


@query(f"{_SEEDS} select {_SEMANTIC} as scope, not has or {_sql_says('t', scope.BROAD_SALT_PATTERNS)} as extended, count(*) as n from t group by 1, 2")
def semantic_scope(spark: SparkSession, d: str) -> DataFrame:
    """Semantic classes of the scope texts, and whether numbers are enough."""
    t, has = F.col("t"), F.col("has")
    return _seeds(spark, d).groupBy(scope.semantic_scope(t, has).alias("scope"), scope.needs_more_than_number(t, has).alias("extended")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""{_SEEDS}, a as (select case when {_sql_says('t', scope.BROAD_SALT_PATTERNS)} then 'BROAD_SALT' when {_sql_says('t', scope.MIXTURE_PATTERNS)} then 'MIXTURE' when {_sql_says('t', scope.STRUCTURAL_RANGE_PATTERNS)} then 'STRUCTURAL_RANGE'
 when {_sql_says('t', scope.GENERIC_GROUP_PATTERNS)} then 'GENERIC_GROUP' when {_sql_says('t', scope.SALT_FAMILY_PATTERNS)} then 'SALT_FAMILY' else 'OTHER' end as before, {_SEMANTIC} as after from t) select before, after, count(*) as n from a group by 1, 2""")
def reclassification_audit(spark: SparkSession, d: str) -> DataFrame:
    """How the plain classes move when numbers are taken into account."""
    return _seeds(spark, d).groupBy(scope.identity_class(F.col("t")).alias("before"), scope.semantic_scope(F.col("t"), F.col("has")).alias("after")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""
with r as (select case_id, coalesce(regulatory_scope_text, '') || ' ' || coalesce(reference_parent_cas, '') as t, list_distinct(regexp_extract_all(coalesce(candidate_cas, ''), '(?:^|[^0-9])(\d{2,7}-\d{2}-\d)(?:[^0-9]|$)', 1)) as ns from identity_e2e_v6_72)
select case_id, bool_and(len(list_filter(ns, lambda n: not contains(t, n))) = 0) as traced from r group by 1""")
def source_traceability(spark: SparkSession, d: str) -> DataFrame:
    """Whether a case's numbers all stand in its source; true without any."""
    e = table(spark, d, "identity_e2e_v6_72")
    source = F.concat(F.coalesce("regulatory_scope_text", F.lit("")), F.lit(" "), F.coalesce("reference_parent_cas", F.lit("")))
    ok = scope.traced(C.numbers_in(F.coalesce("candidate_cas", F.lit(""))), source)
    return e.groupBy("case_id").agg(F.bool_and(ok).alias("traced"))


_GROUP = """with m as (select distinct trim(candidate_cas, ' ') as cas, upper(trim(rule_id, ' ')) as rule from group_membership_v1_50 where reference_membership = 'MATCH' and trim(candidate_cas, ' ') <> '' and trim(rule_id, ' ') <> ''),
s as (select seed_id, trim(coalesce(candidate_cas, ''), ' ') as cas, upper(trim(coalesce(target_rule_id, ''), ' ')) as rule, lower(coalesce(candidate_name, '')) as name from (select *, row_number() over (partition by seed_id order by loaded_at) as rn from chemical_group_candidates_seed) where rn = 1),
g as (select s.*, case when t.cas is not null then 'MATCH' when e.cas is not null then 'NO_MATCH' when s.rule = 'NURIC_SALTS' then case when contains(name, 'sodium') then 'MATCH' else 'REVIEW' end
  when s.rule = 'TRELL_COMPOUNDS' then case when contains(name, 'bromo') then 'MATCH' when not contains(name, 'chloro') then 'NO_MATCH' else 'REVIEW' end else 'REVIEW' end as gate,
 case when t.cas is not null then 'CAS_IN_TARGET_GROUP' when e.cas is not null then 'CAS_ONLY_IN_OTHER_GROUP' when s.rule = 'NURIC_SALTS' then case when contains(name, 'sodium') then 'FALLBACK_MATCH' else 'OPEN_WORLD_SALT' end
  when s.rule = 'TRELL_COMPOUNDS' then case when contains(name, 'bromo') then 'FALLBACK_MATCH' when not contains(name, 'chloro') then 'FALLBACK_NO_MATCH' else 'OPEN_WORLD_HALOGEN' end else 'NO_DETERMINISTIC_RULE' end as gate_reason
 from s left join m t on s.cas = t.cas and s.rule = t.rule left join (select distinct cas from m) e on s.cas = e.cas)"""


def _group_gated(spark: SparkSession, d: str) -> DataFrame:
    key = lambda c: F.upper(F.trim(c))
    m = table(spark, d, "group_membership_v1_50").filter("reference_membership = 'MATCH'").select(key("rule_id").alias("rule"), F.trim("candidate_cas").alias("cas")).filter("cas <> '' and rule <> ''")
    first = F.min_by(F.struct(F.trim(F.coalesce("candidate_cas", F.lit(""))).alias("cas"), key(F.coalesce("target_rule_id", F.lit(""))).alias("rule"), F.lower(F.coalesce("candidate_name", F.lit(""))).alias("name")), "loaded_at")
    seeds = table(spark, d, "chemical_group_candidates_seed").groupBy("seed_id").agg(first.alias("s")).select("seed_id", "s.*")
    name = F.col("name")
    fallback = {"NURIC_SALTS": (name.contains("sodium"), None, "OPEN_WORLD_SALT"), "TRELL_COMPOUNDS": (name.contains("bromo"), ~name.contains("chloro"), "OPEN_WORLD_HALOGEN")}
    return gates.group_gate(seeds, m, "rule", "cas", fallback)


@query(_GROUP + " select gate, gate_reason, count(*) as n from g group by 1, 2")
def group_gate(spark: SparkSession, d: str) -> DataFrame:
    """Membership of the group, of others only, by the group's fallback, or for review."""
    return _group_gated(spark, d).groupBy("gate", "gate_reason").agg(F.count(F.lit(1)).alias("n"))


@query(_GROUP + """, x as (select g.*, threshold_pct as lim, threshold_operator as op, f, case when f > 0 then round(threshold_pct * f, 6) end as pct from g left join (select distinct on (rule_id) * from group_rules) r on g.rule = r.rule_id cross join (values (0.99::double), (1.0::double), (1.01::double), (-1.0::double)) v(f))
select f as factor, case when gate <> 'MATCH' then gate when pct is null or lim is null then 'REVIEW' when (op = '>=' and pct >= lim - 1e-12) or (op = '>' and pct > lim + 1e-12) then 'MATCH' else 'NO_MATCH' end as decision, count(*) as n from x group by 1, 2""")
def mixture_gate_review(spark: SparkSession, d: str) -> DataFrame:
    """The group gate, then the group's limit; missing shares are for review."""
    r = table(spark, d, "group_rules").dropDuplicates(["rule_id"]).select(F.col("rule_id").alias("rule"), "threshold_pct", "threshold_operator")
    x = _group_gated(spark, d).join(r, "rule", "left").withColumn("factor", F.explode(F.array(*[F.lit(f) for f in (0.99, 1.0, 1.01, -1.0)])))
    share = F.when(F.col("factor") > 0, F.round(F.col("threshold_pct") * F.col("factor"), 6))
    return gates.mixture_gate(x, share, F.col("threshold_pct"), F.col("threshold_operator")).groupBy("factor", "decision").agg(F.count(F.lit(1)).alias("n"))


_SPLIT = r"list_sort(list_distinct(list_filter(list_transform(string_split(replace(coalesce({0}, ''), ';', '|'), '|'), lambda x: trim(x, ' ')), lambda x: regexp_matches(x, '^\d{{2,7}}-\d{{2}}-\d$'))))"


def _parts(c: str):
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(F.replace(F.coalesce(c, F.lit("")), F.lit(";"), F.lit("|")), r"\|"), lambda x: F.trim(x)), lambda x: x.rlike(r"^\d{2,7}-\d{2}-\d$"))))


_RETRIEVAL = f"""with one as (select * from (select *, row_number() over (partition by seed_id order by loaded_at, coalesce(candidate_components, ''), coalesce(target_components, '')) as rn from mixture_candidates_seed) where rn = 1),
q as (select seed_id as query_id, {_SPLIT.format('candidate_components')} as ns, target_scope_id, gold_label from one),
c as (select distinct 'MX::' || target_scope_id as target, {_SPLIT.format('target_components')} as ns from mixture_candidates_seed where target_scope_id is not null),
m as (select distinct trim(official_mixture_cas, ' ') as n, 'MX::' || target_scope_id as target from mixture_regulatory_reference where target_scope_id is not null union select distinct trim(candidate_cas, ' '), 'CG::' || upper(trim(rule_id, ' ')) from group_membership_v1_50 where reference_membership = 'MATCH' and trim(rule_id, ' ') <> ''),
s as (select ns, count(distinct target) as k, min(target) as one from c where len(ns) > 0 group by 1), u as (select n, count(distinct target) as k, min(target) as one from m where n is not null group by 1),
h as (select seed_id as query_id, 'PS::' || min(substr(candidate_cas, 1, 9)) as one, 1 as k from mixture_candidates_seed where gold_label = 'MATCH' and trim(candidate_cas, ' ') <> '' and length(seed_id) > 0 group by 1),
g as (select q.query_id, case when len(q.ns) > 1 then case when s.k = 1 then 'FOUND' else 'REVIEW' end when len(q.ns) = 0 then 'REVIEW' when u.k = 1 then 'FOUND' when u.k > 1 then 'REVIEW' when h.k = 1 then 'FOUND' else 'REVIEW' end as gate_status,
 case when len(q.ns) > 1 then case when s.k = 1 then s.one else '' end when len(q.ns) = 0 then '' when u.k = 1 then u.one when u.k > 1 then '' when h.k = 1 then h.one else '' end as gate_target_id,
 case when len(q.ns) > 1 then case when s.k = 1 then 'EXACT_MIXTURE_COMPONENT_CAS_SET' else 'NO_UNIQUE_EXACT_MIXTURE_COMPONENT_SET' end when len(q.ns) = 0 then 'CAS_INPUT_UNRESOLVED' when u.k = 1 then 'EXACT_CAS_IN_REGULATORY_CATALOG' when u.k > 1 then 'CAS_MAPS_TO_MULTIPLE_CATALOG_TARGETS' when h.k = 1 then 'UNIQUE_STRUCTURE_MATCH' else 'NO_HIGH_CONFIDENCE_DETERMINISTIC_TARGET' end as gate_reason
 from q left join s on q.ns = s.ns left join u on len(q.ns) = 1 and q.ns[1] = u.n left join h on q.query_id = h.query_id)"""


def _retrieval(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    seeds = table(spark, d, "mixture_candidates_seed")
    first = F.min_by(F.struct("candidate_components", "target_scope_id", "gold_label"), F.struct("loaded_at", F.coalesce("candidate_components", F.lit("")).alias("a"), F.coalesce("target_components", F.lit("")).alias("b")))
    q = seeds.groupBy(F.col("seed_id").alias("query_id")).agg(first.alias("s")).select("query_id", "s.*")
    scoped = seeds.filter("target_scope_id is not null").select(F.concat(F.lit("MX::"), "target_scope_id").alias("target_id"), F.lit("components").alias("kind"), _parts("target_components").alias("numbers"))
    official = table(spark, d, "mixture_regulatory_reference").filter("target_scope_id is not null").select(F.concat(F.lit("MX::"), "target_scope_id").alias("target_id"), F.lit("member").alias("kind"), F.array(F.trim("official_mixture_cas")).alias("numbers"))
    groups = table(spark, d, "group_membership_v1_50").filter("reference_membership = 'MATCH' and trim(rule_id) <> ''").select(F.concat(F.lit("CG::"), F.upper(F.trim("rule_id"))).alias("target_id"), F.lit("member").alias("kind"), F.array(F.trim("candidate_cas")).alias("numbers"))
    hits = seeds.filter("gold_label = 'MATCH' and trim(candidate_cas) <> '' and length(seed_id) > 0").groupBy(F.col("seed_id").alias("query_id")).agg(F.concat(F.lit("PS::"), F.min(F.substring("candidate_cas", 1, 9))).alias("target_id"))
    return gates.retrieval_gate(q.withColumn("numbers", _parts("candidate_components")), scoped.unionByName(official).unionByName(groups), hits), q


@query(_RETRIEVAL + " select query_id, gate_status, gate_target_id, gate_reason from g")
def retrieval_gate(spark: SparkSession, d: str) -> DataFrame:
    """The target each query stands for, as far as its numbers tell: by set, by member, by structure, or for review."""
    return _retrieval(spark, d)[0]


@query(_RETRIEVAL + """, k as (select g.query_id, case when gold_label = 'MATCH' and target_scope_id is not null then 'MX::' || target_scope_id else 'NOT_FOUND' end as gold_target_id, gate_target_id from g join q on g.query_id = q.query_id where gate_status = 'FOUND')
select query_id, gold_target_id, gate_target_id, case when gold_target_id = 'NOT_FOUND' then 'GOLD_NOT_FOUND_GATE_FOUND' else 'GOLD_AND_GATE_DIFFERENT_TARGET' end as conflict_type from k where gold_target_id <> gate_target_id""")
def gate_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Decisions of the gate that the gold labels contradict."""
    gate, q = _retrieval(spark, d)
    gold = q.select("query_id", F.when((F.col("gold_label") == "MATCH") & F.col("target_scope_id").isNotNull(), F.concat(F.lit("MX::"), "target_scope_id")).otherwise("NOT_FOUND").alias("gold_target_id"))
    return gates.conflicts(gate, gold)


@query(r"""
with p as (select feed_id, file_seq, line_no, min(payload) as payload from rule_file_records group by 1, 2, 3), t as (select *, trim(payload, ' ') as b from p)
select feed_id, file_seq, line_no, case when starts_with(b, '{') and ends_with(b, '}') and json_valid(b) then b end as object from t where b is null or (starts_with(b, '{') and ends_with(b, '}') and json_valid(b)) or not contains(b, '{')""")
def first_json_object(spark: SparkSession, d: str) -> DataFrame:
    """The first object of answers with thinking, prose, a fence and a broken start around it."""
    one = table(spark, d, "rule_file_records").groupBy("feed_id", "file_seq", "line_no").agg(F.min("payload").alias("payload"))
    b = F.trim("payload")
    one = one.filter(b.isNull() | (b.startswith("{") & b.endswith("}") & F.try_parse_json(b).isNotNull()) | ~F.contains(b, F.lit("{")))
    noisy = F.concat(F.lit('<think>maybe {"a": 1}</think> Sure, {here:\n```json\n'), b, F.lit('\n``` or {"b": 2}'))
    return one.select("feed_id", "file_seq", "line_no", answers.first_object(F.when(F.contains(b, F.lit("{")), noisy).otherwise(b)).alias("object"))


_ALIASES = {"DIRECT": "SINGLE_OR_DIRECT", "GENERIC": "GENERIC_GROUP", "RANGE": "STRUCTURAL_RANGE"}
_ANSWERS = """with a as (select doc_id, coalesce(text, '') as t, case doc_id % 5 when 0 then 'direct' when 1 then 'GENERIC' when 2 then 'RANGE' when 3 then 'MANUAL' else 'nonsense' end as raw, case doc_id % 3 when 0 then 'yes' when 1 then 'no' end as flag,
 case when doc_id % 4 = 0 then substr(coalesce(text, ''), 3, 12) else 'no such words' end as quote, case doc_id % 4 when 0 then '0.5' when 1 then '7' when 2 then '-1' else 'high' end as conf from documents),
n as (select *, case upper(raw) when 'DIRECT' then 'SINGLE_OR_DIRECT' when 'GENERIC' then 'GENERIC_GROUP' when 'RANGE' then 'STRUCTURAL_RANGE' else raw end as lab from a),"""


@query(_ANSWERS + """ v as (select *, case when upper(lab) in ('SINGLE_OR_DIRECT', 'GENERIC_GROUP', 'STRUCTURAL_RANGE', 'MANUAL') then upper(lab) else 'MANUAL' end as scope from n)
select doc_id, scope, case when upper(lab) in ('SINGLE_OR_DIRECT', 'GENERIC_GROUP', 'STRUCTURAL_RANGE') then 'OK' else 'MANUAL' end as status, case when scope = 'SINGLE_OR_DIRECT' then false when scope <> 'MANUAL' then true else coalesce(flag in ('yes'), true) end as extended,
case when trim(quote, ' ') <> '' and contains(t, trim(quote, ' ')) then 'EVIDENCE_EXACT_MATCH' else 'EVIDENCE_QUOTE_INVALID' end as evidence, least(1.0, greatest(0.0, try_cast(conf as double))) as confidence from v""")
def validated_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers with labels of a wide vocabulary, checked against their text."""
    k = F.col("doc_id")
    docs = table(spark, d, "documents").withColumn("t", F.coalesce("text", F.lit("")))
    label = F.when(k % 5 == 0, "direct").when(k % 5 == 1, "GENERIC").when(k % 5 == 2, "RANGE").when(k % 5 == 3, "MANUAL").otherwise("nonsense")
    flag = F.when(k % 3 == 0, "yes").when(k % 3 == 1, "no")
    quote = F.when(k % 4 == 0, F.substring("t", 3, 12)).otherwise("no such words")
    conf = F.when(k % 4 == 0, "0.5").when(k % 4 == 1, "7").when(k % 4 == 2, "-1").otherwise("high")
    raw = docs.select("doc_id", "t", F.to_json(F.struct(label.alias("scope_type"))).alias("j"), flag.alias("flag"), quote.alias("quote"), conf.alias("conf"))
    raw = raw.withColumn("j", answers.with_aliases(F.col("j"), "scope_type", _ALIASES))
    cols = answers.validated(F.get_json_object("j", "$.scope_type"), F.col("flag"), F.col("quote"), F.col("conf"), F.col("t"), ["SINGLE_OR_DIRECT", "GENERIC_GROUP", "STRUCTURAL_RANGE", "MANUAL"], "SINGLE_OR_DIRECT", "MANUAL")
    return raw.select("doc_id", *[c.alias(n) if not isinstance(c, str) else F.lit(c).alias(n) for n, c in cols.items()])


@query("""select rule_id, '{"rule_id":"' || rule_id || '","limit":"' || coalesce(threshold_operator, '') || '","text":"' || coalesce(scope_text, '') || '"}' as payload, sha256('{"rule_id":"' || rule_id || '","limit":"' || coalesce(threshold_operator, '') || '","text":"' || coalesce(scope_text, '') || '"}') as digest from group_rules""")
def payload_manifest(spark: SparkSession, d: str) -> DataFrame:
    """One JSON payload a rule, with its hash."""
    p = answers.payload({"rule_id": F.col("rule_id"), "limit": F.col("threshold_operator"), "text": F.col("scope_text")})
    return table(spark, d, "group_rules").select("rule_id", p.alias("payload"), F.sha2(p, 256).alias("digest"))


_EVENT = "case event_type when 'purchase' then 'MATCH' when 'signup' then 'MATCH' when 'view' then 'NO_MATCH' when 'click' then 'NO_MATCH' end"


@query(f"""
with u as (select user_id, case when user_id % 3 = 0 then 'MATCH' when user_id % 3 = 1 then 'NO_MATCH' end as r from (select distinct user_id from events)), a as (select user_id, event_id % 2 as rep, arg_min({_EVENT}, event_id) filter ({_EVENT} is not null) as p, min(event_id) as m, arg_min(coalesce({_EVENT}, '~'), event_id) as f from events group by 1, 2),
w as (select distinct rep from a), j as (select u.user_id, w.rep, r, case when f <> '~' then f end as p, coalesce(f <> '~', false) as ok from u cross join w left join a on a.user_id = u.user_id and a.rep = w.rep),
s as (select rep, 'RULE' as system, r as p, ok from j union all select rep, 'MODEL', case when ok then p end, ok from j union all select rep, 'HYBRID', coalesce(r, case when ok then p end), ok from j)
select rep, system, p as prediction, ok as available, count(*) as n from s group by 1, 2, 3, 4""")
def three_system_frame(spark: SparkSession, d: str) -> DataFrame:
    """A rule's, a model's and their hybrid's answers in each repeat; the model's is a user's first event in it."""
    e = table(spark, d, "events").withColumn("rep", F.col("event_id") % 2)
    kind = F.when(F.col("event_type").isin("purchase", "signup"), "MATCH").when(F.col("event_type").isin("view", "click"), "NO_MATCH")
    a = e.groupBy("user_id", "rep").agg(F.min_by(F.struct(kind.alias("prediction")), "event_id").alias("s")).select("user_id", "rep", "s.prediction").withColumn("valid", F.col("prediction").isNotNull())
    u = e.select("user_id").distinct().withColumn("r", F.when(F.col("user_id") % 3 == 0, "MATCH").when(F.col("user_id") % 3 == 1, "NO_MATCH"))
    return gates.three_systems(u, a, "user_id", "r", ["rep"]).groupBy("rep", "system", "prediction", "available").agg(F.count(F.lit(1)).alias("n"))


@query("""
with c as (select user_id, count(*) filter (event_type <> 'error') as n_ok, count(*) as n_calls from events where event_id % 2 = 0 group by 1), w as (select distinct user_id from events), j as (select coalesce(n_ok, 0) as n_ok, coalesce(n_calls, 0) as n_calls from w left join c on w.user_id = c.user_id)
select case when n_ok = 20 then 'COMPLETE' when n_calls = 0 then 'MISSING' when n_ok < 20 then 'SHORT' else 'SURPLUS' end as state, count(*) as n, cast(sum(n_ok) as bigint) as n_ok from j group by 1""")
def completeness_gate(spark: SparkSession, d: str) -> DataFrame:
    """Whether every user has exactly twenty good calls."""
    e = table(spark, d, "events")
    out = gates.completeness(e.filter("event_id % 2 = 0"), e, "user_id", F.col("event_type") != "error", 20)
    return out.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.sum("n_ok").alias("n_ok"))


@query("""
with e as (select user_id % 10 as grp, user_id, ntile(2) over (partition by user_id order by event_id) as half, value from events), m as (select grp, user_id, half, avg(value) > 40 as high from e group by 1, 2, 3), p as (select grp, user_id, count(*) as n, count(distinct high) as k from m group by 1, 2)
select grp, count(*) as n_complete, count(*) filter (k = 1) as n_agree, round(count(*) filter (k = 1) / count(*), 6) as agreement from p where n = 2 group by 1""")
def repeat_consistency(spark: SparkSession, d: str) -> DataFrame:
    """Users whose two halves of events come to the same answer."""
    from pyspark.sql import Window

    e = table(spark, d, "events").select((F.col("user_id") % 10).alias("grp"), "user_id", "value", F.ntile(2).over(Window.partitionBy("user_id").orderBy("event_id")).alias("half"))
    m = e.groupBy("grp", "user_id", "half").agg((F.avg("value") > 40).alias("high"))
    return votes.consistency(m, "grp", "user_id", "high", 2)


_RULE_TEXTS = ["A-acid | 50-00-0, 64-17-5 | x | y | z | 급성독성 | 0.5 이상 sodium: 0.3, zinc salt: 1.5", "no category | 7732-18-5", "- | 부여되지 않음 | - | a | b | 만성독성 | none"]


@query(f"""
with r as (select rule_id, row_number() over (order by rule_id) % 4 as k, length(rule_id) % 2 = 0 as listed from group_rules)
select rule_id, case when listed then '1-1-1;2-2-2' when k = 0 then '50-00-0;64-17-5' else '' end as numbers, case when k = 0 then 0.5 end as general, case when k = 0 then '이상 sodium=0.3;, zinc salt=1.5' else '' end as special, case k when 0 then 'A-acid' when 1 then 'no category' when 2 then 'none' else '' end as name from r""")
def rule_fields(spark: SparkSession, d: str) -> DataFrame:
    """Numbers from their field or cell, former limits and names, of rule rows whose texts are of four kinds."""
    from pyspark.sql import Window

    k = F.row_number().over(Window.orderBy("rule_id")) % 4  # the registry, one row a rule
    t = F.coalesce(*[F.when(k == i, x) for i, x in enumerate(_RULE_TEXTS)])
    rows = table(spark, d, "group_rules").select("rule_id", t.alias("t"), F.when(F.length("rule_id") % 2 == 0, "1-1-1; 2-2-2").alias("p"))
    general, special = rules.old_limits(F.lit(None).cast("string"), F.col("t"))
    pairs = F.array_join(F.transform(special, lambda s: F.concat(s["name"], F.lit("="), s["limit"].cast("string"))), ";")
    return rows.select("rule_id", F.array_join(rules.direct_numbers(F.col("p"), F.col("t")), ";").alias("numbers"), general.alias("general"), pairs.alias("special"), rules.guessed_name(F.col("t")).alias("name"))


@query(r"""
with c as (select rule_id, notes, reference_parent_cas from broad_salt_rules_curated_13),
s as (select coalesce(regexp_extract(reference_parent_cas, '(\d{2,7}-\d{2}-\d)', 1), '') as a, regexp_replace(coalesce(reference_parent_cas, ''), '[\s\p{Z}]+', '', 'g') as b from c)
select a = b as same, b = '' as none, count(*) as n from s group by 1, 2""")
def number_normalisers(spark: SparkSession, d: str) -> DataFrame:
    """The first number in a field against the field without blanks."""
    c = F.col("reference_parent_cas")
    r = table(spark, d, "broad_salt_rules_curated_13").select(rules.first_number(c).alias("a"), rules.bare_number(c).alias("b"))
    return r.groupBy((F.col("a") == F.col("b")).alias("same"), (F.col("b") == "").alias("none")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""
with l as (select rule_id, case when regexp_matches(coalesce(regulatory_source, ''), '\d{4}[\s\p{Z}]*-[\s\p{Z}]*0*\d+') then regexp_extract(regulatory_source, '(\d{4})[\s\p{Z}]*-[\s\p{Z}]*0*(\d+)', 1) || '-' || try_cast(regexp_extract(regulatory_source, '(\d{4})[\s\p{Z}]*-[\s\p{Z}]*0*(\d+)', 2) as bigint)
 when regexp_matches(coalesce(frozen_date, ''), '^\d{4}') and regexp_matches(coalesce(regulatory_source, ''), '\d') then substr(frozen_date, 1, 4) || '-' || try_cast(list_last(regexp_extract_all(regulatory_source, '\d+')) as bigint) else '' end as label from broad_salt_rules_curated_13)
select label, count(*) as n from l group by 1""")
def notice_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of the notices that rules cite."""
    r = table(spark, d, "broad_salt_rules_curated_13")
    return r.groupBy(rules.notice_label(F.col("regulatory_source"), F.col("frozen_date")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("""
with t as (select case when trim(coalesce(target_scope_id, ''), ' ') <> '' then 'MX::' || trim(target_scope_id, ' ') end as target from mixture_candidates_seed union all select case when trim(coalesce(target_rule_id, ''), ' ') <> '' then 'CG::' || trim(target_rule_id, ' ') end from chemical_group_candidates_seed
 union all select case when regexp_replace(coalesce(reference_parent_cas, ''), '[\\s\\p{Z}]+', '', 'g') <> '' then 'PS::' || regexp_replace(reference_parent_cas, '[\\s\\p{Z}]+', '', 'g') end from identity_e2e_v6_72)
select case when target is null then 'OTHER' when target like 'PS::%' then 'PARENT_SALT' when target like 'CG::%' then 'CHEMICAL_GROUP' else 'MIXTURE' end as category, count(*) as n, count(distinct target) as n_targets from t group by 1""".replace("\\\\", "\\"))
def target_ids(spark: SparkSession, d: str) -> DataFrame:
    """Targets of the three kinds of cases, and back to their kind."""
    none = F.lit(None).cast("string")
    mk = lambda name, kind, c: table(spark, d, name).select(rules.target_id(F.lit(kind), *[F.col(c) if k == kind else none for k in ("PARENT_SALT", "CHEMICAL_GROUP", "MIXTURE")]).alias("t"))
    t = mk("mixture_candidates_seed", "MIXTURE", "target_scope_id").unionByName(mk("chemical_group_candidates_seed", "CHEMICAL_GROUP", "target_rule_id")).unionByName(mk("identity_e2e_v6_72", "PARENT_SALT", "reference_parent_cas"))
    return t.groupBy(rules.target_category(F.col("t")).alias("category")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("t").alias("n_targets"))


@query("""
with p as (select p_partkey, case p_size % 6 when 0 then 'salt_parent' when 1 then 'SUBSTRUCTURE' when 2 then 'STRUCTURAL_RANGE' when 3 then 'MIXTURE_COMPONENT' when 4 then 'REACTION_MASS' else 'MANUAL' end as m, case when p_size % 4 = 0 then '' else p_name end as ref, case when p_size % 7 = 0 then null else p_size end as low, p_partkey % 3 as k from part)
select case when m = 'salt_parent' then ref <> '' when m = 'SUBSTRUCTURE' then ref <> '' when m = 'STRUCTURAL_RANGE' then low is not null when m = 'MIXTURE_COMPONENT' then k > 0 when m = 'REACTION_MASS' then k >= 2 or (k = 1 and low >= 2) else false end and not (m = 'REACTION_MASS' and k = 1 and low is null) as ok,
case when m = 'salt_parent' then 'REFERENCE_PARENT_SMILES_REQUIRED' when m = 'SUBSTRUCTURE' then case when ref <> '' then 'SMARTS_MUST_PARSE' else 'REQUIRED_SMARTS_MISSING' end when m = 'STRUCTURAL_RANGE' then case when low is null then 'CARBON_RANGE_REQUIRED' else 'STRUCTURAL_RANGE_EXECUTABLE' end
 when m = 'MANUAL' then 'MANUAL_OR_UNSUPPORTED_RULE_MODE' when k = 0 then 'CONSTITUENT_CAS_CRITERIA_REQUIRED' when m = 'REACTION_MASS' and not (k >= 2 or coalesce(low >= 2, false)) then 'REACTION_MASS_REQUIRES_MULTI_CONSTITUENT_DEFINITION' else 'COMPOSITION_RULE_EXECUTABLE' end as reason, count(*) as n from p group by 1, 2""")
def rule_executability(spark: SparkSession, d: str) -> DataFrame:
    """Whether rules held as rows can be run, by mode, with the reason."""
    s, ref = F.col("p_size"), F.when(F.col("p_size") % 4 == 0, "").otherwise(F.col("p_name"))
    mode = F.when(s % 6 == 0, "salt_parent").when(s % 6 == 1, "SUBSTRUCTURE").when(s % 6 == 2, "STRUCTURAL_RANGE").when(s % 6 == 3, "MIXTURE_COMPONENT").when(s % 6 == 4, "REACTION_MASS").otherwise("MANUAL")
    low = F.when(s % 7 != 0, s.cast("double"))
    members = F.transform(F.slice(F.array(F.lit(1), F.lit(2)), F.lit(1), (F.col("p_partkey") % 3).cast("int")), lambda x: x.cast("string"))
    r = rules.executable(mode, ref, ref, low, F.lit(None).cast("double"), members, low)
    return table(spark, d, "part").select(r.alias("r")).groupBy("r.ok", "r.reason").agg(F.count(F.lit(1)).alias("n"))


@query("""
with r as (select rule_id, case when length(rule_id) % 5 = 0 then '삭제' when length(rule_id) % 5 = 1 then '-' else rule_id end as name, case when length(rule_id) % 5 = 1 then '< 삭 제 >' when length(rule_id) % 5 = 2 then '일부 삭제 후 유지' else 'text' end as source, case when length(rule_id) % 5 = 3 then 'Deleted' else 'live' end as status from group_rules)
select case when name = '삭제' then 'SUBSTANCE_NAME_DELETED_PLACEHOLDER' when status = 'Deleted' then 'STATUS_COLUMN_DELETED:status' when name = '-' then 'EMPTY_IDENTITY_DELETED_PLACEHOLDER' end as reason, count(*) as n from r group by 1""")
def deleted_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows that only mark a deletion, by why."""
    k = F.length("rule_id") % 5
    name = F.when(k == 0, "삭제").when(k == 1, "-").otherwise(F.col("rule_id"))
    source = F.when(k == 1, "< 삭 제 >").when(k == 2, "일부 삭제 후 유지").otherwise("text")
    why = rules.deleted_row(name, source, F.array(), {"status": F.when(k == 3, "Deleted").otherwise("live")})
    return table(spark, d, "group_rules").groupBy(why.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


_ASKS = r"""with t as (select doc_id, coalesce(text, '') as t from documents), f as (select doc_id, regexp_matches(t, '(?:^|[^0-9])\d{2,7}-\d{2}-\d(?:[^0-9]|$)') as has, regexp_matches(t, '\d+(?:\.\d+)?[\s]*%') as c, regexp_matches(t, '용도|사용용도|특정\s*용도|용도로') as u, regexp_matches(t, '(?i)\d+(?:\.\d+)?[\s\p{Z}]*(?:kg|킬로그램|톤|ton|t)(?:[^\p{L}\p{N}_]|$)') as q,
 regexp_matches(t, '시행일|유예|경과조치|\d{4}\s*년\s*\d{1,2}\s*월') as z, regexp_matches(t, '허가|승인|신고|금지|제한') as a, """


@query(_ASKS + f"""{_sql_says('t', scope.BROAD_SALT_PATTERNS)} as b from t)
select case when has and (u or z or a) then 'AI_ASSISTED_CONDITION_CANDIDATE' when has then 'DETERMINISTIC_AUTO_CANDIDATE' when b and has then 'AI_ASSISTED_IDENTITY_CANDIDATE' else 'REVIEW_REQUIRED' end as route, concat_ws(';', case when c then 'concentration' end, case when u then 'use' end, case when q then 'quantity' end, case when z then 'time' end, case when a then 'authorization' end) as dimensions,
concat_ws(';', 'cas', case when c then 'concentration_pct' end, case when u then 'use_description' end, case when q then 'annual_quantity_kg' end, case when z then 'as_of_date' end, case when a then 'authorization_status' end) as required_fields, count(*) as n from f group by 1, 2, 3""")
def rule_routes(spark: SparkSession, d: str) -> DataFrame:
    """What each text asks for besides a number, and how far it can be decided by fields."""
    t, none = F.col("t"), F.lit(None).cast("string")
    docs = table(spark, d, "documents").select(F.coalesce("text", F.lit("")).alias("t"))
    asks = rules.dimensions(t, F.lit(None).cast("double"), none, none, none, none)
    cols = rules.rule_route(t, t.rlike(C.NUMBER_PATTERN), asks)
    return docs.groupBy(*[c.alias(k) for k, c in cols.items()]).agg(F.count(F.lit(1)).alias("n"))


@query("""
with o as (select o_orderkey, o_custkey % 100 as part, case when o_orderkey % 11 = 0 then '금 지물질' when o_orderkey % 13 = 0 then '제한대상' when o_orderkey % 17 = 0 then '금지대상 제한대상' end as t from orders),
r as (select *, case when t = '금 지물질' then 'PROHIBITED' when t = '제한대상' then 'RESTRICTED' end as k from o)
select coalesce(c, '') as category, count(*) as n from (select last_value(k ignore nulls) over (partition by part order by o_orderkey rows between unbounded preceding and current row) as c from r) group by 1""")
def restriction_carried(spark: SparkSession, d: str) -> DataFrame:
    """The kind of restriction that rows name, carried on to those that name none or both."""
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select(k, (F.col("o_custkey") % 100).alias("part"), F.when(k % 11 == 0, "금 지물질").when(k % 13 == 0, "제한대상").when(k % 17 == 0, "금지대상 제한대상").alias("t"))
    kind = rules.restriction(F.col("t"))
    return windows.carried(o, "part", ["o_orderkey"], kind.isNotNull(), kind).groupBy(F.coalesce("carried", F.lit("")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("""
select p_type, min(least(l1, l2, l3)) as least_limit, count(least(l1, l2, l3)) as n_with_limit from (select p_type, case when p_size % 2 = 0 then p_size / 10.0 end as l1, case when p_size % 3 = 0 then round(p_retailprice, 1) end as l2, case when p_size % 5 = 0 then cast(p_size as double) end as l3 from part) group by 1""")
def least_limits(spark: SparkSession, d: str) -> DataFrame:
    """The lowest of several limit columns, then of the rows."""
    s = F.col("p_size")
    low = rules.least_limit([F.when(s % 2 == 0, s / 10.0), F.when(s % 3 == 0, F.round("p_retailprice", 1)), F.when(s % 5 == 0, s.cast("double"))])
    return table(spark, d, "part").select("p_type", low.alias("l")).groupBy("p_type").agg(F.min("l").alias("least_limit"), F.count("l").alias("n_with_limit"))


@query("""
with s as (select distinct smiles from broad_salt_validation_cases where trim(smiles, ' ') <> ''), p as (select smiles, regexp_replace(trim(smiles, ' '), '\\[[^\\]]*\\]', '', 'g') as plain from s)
select len(regexp_extract_all(replace(plain, 'Cl', ''), 'C|c')) + len(regexp_extract_all(smiles, '\\[[0-9]*(?:C[^adeflmnorsu]|c)')) as carbons, count(*) as n from p group by 1""".replace("\\\\", "\\"))
def carbon_counts(spark: SparkSession, d: str) -> DataFrame:
    """Structures by their number of carbon atoms."""
    s = table(spark, d, "broad_salt_validation_cases").filter("trim(smiles) <> ''").select("smiles").distinct()
    return s.groupBy(rules.carbon_count(F.col("smiles")).cast("long").alias("carbons")).agg(F.count(F.lit(1)).alias("n"))


@query("""
with f as (select case when a.scope_text = b.scope_text and a.n = b.n then 'SAME' when b.rule_id is null then 'UNLISTED' else 'CHANGED' end as state from (select 'group_rules' as rule_id, 1 as n, 'a' as scope_text) a left join (select 'group_rules' as rule_id, 1 as n, 'a' as scope_text) b on a.rule_id = b.rule_id)
select 'group_rules' as artifact, state from f union all select 'nation', 'CHANGED' union all select 'region', 'UNLISTED' union all select 'supplier', 'MISSING'""")
def verified_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables against a manifest of which one is the same, one changed, one unlisted and one missing."""
    one = lambda name, *cols: G.frozen(table(spark, d, name), name, cols)
    actual = one("group_rules", "rule_id", "scope_text").unionByName(one("nation", "n_name")).unionByName(one("region", "r_name"))
    manifest = one("group_rules", "rule_id", "scope_text").unionByName(G.frozen(table(spark, d, "nation").filter("n_nationkey > 0"), "nation", ["n_name"])).unionByName(one("supplier", "s_name"))
    return G.verified(actual, manifest)


@query("""
with c as (select case_id, min(coalesce(challenge_class, '')) as cl, min(split) as split from identity_e2e_v6_72 group by 1), r as (select *, cl like '%salt%' as hard, sha256('s20260828' || case_id) as h from c), n as (select count(*) filter (hard) as hard, count(*) filter (hard) + 40 as want from r)
select case_id, split, case when hard then 'CHALLENGE' else 'CONTROL' end as reason from (select *, row_number() over (partition by hard order by h, case_id) as k from r) where hard or k <= 40""")
def challenge_sample(spark: SparkSession, d: str) -> DataFrame:
    """All salt challenges and forty controls by a seeded hash."""
    c = table(spark, d, "identity_e2e_v6_72").groupBy("case_id").agg(F.min(F.coalesce("challenge_class", F.lit(""))).alias("cl"), F.min("split").alias("split"))
    hard = F.col("cl").contains("salt")
    return G.challenge_sample(c, hard, "split", "case_id", "s20260828", c.filter(hard).count() + 40)


@query("""
with s as (select seed_id, min(upper(trim(target_rule_id, ' '))) as rule, min(gold_label) as gold from chemical_group_candidates_seed group by 1), r as (select *, coalesce(gold = 'MATCH', false) as p, row_number() over (partition by rule, coalesce(gold = 'MATCH', false) order by seed_id) as place from s where rule is not null),
k as (select * from r where place <= 5), q as (select rule, least(count(*) filter (p), count(*) filter (not p)) as n from k group by 1), b as (select rule, n, coalesce(sum(n) over (order by rule rows between unbounded preceding and 1 preceding), 0) as before from q)
select k.rule, seed_id, k.p as positive, cast(place as integer) as place from k join b on k.rule = b.rule where place <= greatest(0, least(n, 60 - before))""")
def paired_quota(spark: SparkSession, d: str) -> DataFrame:
    """Per rule as many positives as negatives, ten at most, while 120 of all fit."""
    s = table(spark, d, "chemical_group_candidates_seed").groupBy("seed_id").agg(F.min(F.upper(F.trim("target_rule_id"))).alias("rule"), F.min("gold_label").alias("gold")).filter("rule is not null")
    out = G.paired_quota(s, "rule", F.col("gold") == "MATCH", [F.col("seed_id")], 10, 120)
    return out.select("rule", "seed_id", F.coalesce(F.col("gold") == "MATCH", F.lit(False)).alias("positive"), "place")


@query("""
select year(o_orderdate) as y, o_orderstatus, count(*) as n, cast(round(sum(case when year(o_orderdate) = 2000 then o_totalprice + 1 else o_totalprice end), 2) as double) as total from orders group by 1, 2""")
def replace_approved(spark: SparkSession, d: str) -> DataFrame:
    """A year's orders replaced by an approved candidate, which holds some of them twice."""
    o = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").cast("long").alias("y"), "o_orderstatus", "o_totalprice")
    c = o.filter("y = 2000").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    out = G.replaced(o, c.unionByName(c.filter("o_orderkey % 3 = 0")), "y", ["o_orderkey"], True)
    return out.groupBy("y", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""
with m as (select trim(candidate_cas, ' ') as number, upper(trim(rule_id, ' ')) as rule from group_membership_v1_50 where reference_membership = 'MATCH' and trim(candidate_cas, ' ') <> '' and trim(rule_id, ' ') <> '') select number, string_agg(distinct rule, ';' order by rule) as groups from m group by 1""")
def inverted_registry(spark: SparkSession, d: str) -> DataFrame:
    """The groups each number belongs to."""
    m = table(spark, d, "group_membership_v1_50").filter("reference_membership = 'MATCH' and trim(candidate_cas) <> '' and trim(rule_id) <> ''")
    return tables.inverted(m.select(F.trim("candidate_cas").alias("number"), F.upper(F.trim("rule_id")).alias("rule")), "rule", "number")


@query(r"""
with r as (select case_id, coalesce(chemical_name, '') || ' | ' || coalesce(cas, '') || ' | ' || coalesce(notes, '') as text, rule_id, loaded_at, case when reference_membership = 'MATCH' then 'A' when reference_membership = 'NO_MATCH' then 'B' end as k, row_number() over (partition by case_id order by loaded_at) as rn from broad_salt_validation_cases),
o as (select case_id, text, last_value(k ignore nulls) over (partition by coalesce(rule_id, '') order by loaded_at, case_id rows between unbounded preceding and current row) as c from r where rn = 1)
select coalesce(c, '') as category, count(*) as n, cast(sum(len(list_distinct(regexp_extract_all(text, '(?:^|[^0-9])(\d{2,7}-\d{2}-\d)(?:[^0-9]|$)', 1)))) as bigint) as n_numbers from o where regexp_matches(text, '(?:^|[^0-9])\d{2,7}-\d{2}-\d(?:[^0-9]|$)') group by 1""")
def rules_in_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows that name a number become records, with the category carried on within their rule."""
    t = table(spark, d, "broad_salt_validation_cases")
    one = t.groupBy("case_id").agg(F.min_by(F.struct("chemical_name", "cas", "notes", F.coalesce("rule_id", F.lit("")).alias("rule"), "loaded_at", "reference_membership"), "loaded_at").alias("s")).select("case_id", "s.*")
    kind = F.when(F.col("reference_membership") == "MATCH", "A").when(F.col("reference_membership") == "NO_MATCH", "B")
    out = grids.rules_in_rows(one, "case_id", ["chemical_name", "cas", "notes"], "rule", ["loaded_at", "case_id"], kind)
    return out.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("numbers")).alias("n_numbers"))


@query("""
with t as (select o_orderkey, o_orderstatus, o_totalprice, year(o_orderdate) as y from orders), a as (select * from t where y = (select max(y) from t) or not exists (select 1 from t where y = (select max(y) from t))), b as (select * from a where o_orderstatus = 'X' or not exists (select 1 from a where o_orderstatus = 'X'))
select y, o_orderstatus, count(*) as n from b group by 1, 2""")
def guarded_filter(spark: SparkSession, d: str) -> DataFrame:
    """The latest year, and of it a status that no order has, which therefore keeps them all."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.year("o_orderdate").cast("long").alias("y"))
    last = o.agg(F.max("y").alias("_y"))
    rows = o.crossJoin(F.broadcast(last))
    return windows.guarded(rows, F.col("y") == F.col("_y"), F.col("o_orderstatus") == "X").groupBy("y", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("""
with x as (select user_id % 5 as part, event_id, cast(round(value) as bigint) as n, lag(cast(round(value) as bigint)) over (partition by user_id % 5 order by ts, event_id) as last, ts from events), s as (select part, sum(case when last is null or n <= last then 1 else 0 end) over (partition by part order by ts, event_id) as segment from x)
select part, cast(segment as bigint) as segment, count(*) as n from s group by 1, 2""")
def rising_segments(spark: SparkSession, d: str) -> DataFrame:
    """Runs of events whose value rises, of five hot parts."""
    e = table(spark, d, "events").select((F.col("user_id") % 5).alias("part"), "ts", "event_id", F.round("value").cast("long").alias("v"))
    return windows.rising_segments(e, "part", ["ts", "event_id"], F.col("v")).groupBy("part", "segment").agg(F.count(F.lit(1)).alias("n"))


@query("""select p_partkey, printf('PART_%05d', row_number() over (order by p_retailprice, p_partkey)) as id from part""")
def numbered_rows(spark: SparkSession, d: str) -> DataFrame:
    """Ids by the order of prices."""
    return windows.numbered(table(spark, d, "part").select("p_partkey", "p_retailprice"), ["p_retailprice", "p_partkey"], "PART_%05d").select("p_partkey", "id")


@query("""
with v as (select p_type, concat_ws(';', case when p_size >= p_partkey % 30 then 'acute' end, case when p_partkey % 4 > 0 and p_size >= 20 then 'chronic' end, case when p_size >= 40 then 'eco' end) as categories from part) select p_type, categories, count(*) as n from v group by 1, 2""")
def limit_columns(spark: SparkSession, d: str) -> DataFrame:
    """Categories whose limit, held in columns, is reached; some are missing."""
    limits = {"acute": F.col("p_partkey") % 30, "chronic": F.when(F.col("p_partkey") % 4 > 0, F.lit(20)), "eco": F.lit(40)}
    return table(spark, d, "part").groupBy("p_type", screen.trigger_categories(F.col("p_size"), limits).alias("categories")).agg(F.count(F.lit(1)).alias("n"))


@query("""
with b as (select distinct n_name, n_regionkey from nation where n_nationkey % 5 > 0), s as (select r_regionkey as n_regionkey, r_name, 1 as k from region)
select c_mktsegment, r_name, count(*) as n from customer join nation on c_nationkey = n_nationkey join b on nation.n_name = b.n_name join s on b.n_regionkey = s.n_regionkey group by 1, 2""")
def validated_bridge(spark: SparkSession, d: str) -> DataFrame:
    """Customers led to regions by the valid rows of a bridge only."""
    nation = table(spark, d, "nation")
    items = table(spark, d, "customer").join(nation.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    summary = table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return screen.bridged(items, nation.select("n_name", "n_regionkey", "n_nationkey"), summary, "n_name", "n_regionkey", F.col("n_nationkey") % 5 > 0).groupBy("c_mktsegment", "r_name").agg(F.count(F.lit(1)).alias("n"))


@query("""select s_nationkey, n_name, n_regionkey, count(*) as n from supplier left join nation on s_nationkey = n_nationkey group by 1, 2, 3""")
def unique_join(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers joined to the one row of their nation, which must be unique."""
    one = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name", "n_regionkey")
    return screen.checked_join(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), one, "s_nationkey").groupBy("s_nationkey", "n_name", "n_regionkey").agg(F.count(F.lit(1)).alias("n"))


@query("""
with k as (select l_returnflag, count(*) filter (l_discount > 0.05 and l_tax > 0.04) as tp, count(*) filter (not l_discount > 0.05 and l_tax > 0.04) as fp, count(*) filter (l_discount > 0.05 and not l_tax > 0.04) as fn, count(*) filter (not l_discount > 0.05 and not l_tax > 0.04) as tn from lineitem group by 1)
select l_returnflag, fn as false_safe, fp as over_screening, round((tp + tn) / (tp + fp + fn + tn), 6) as accuracy, round(tn / nullif(tn + fp, 0), 6) as specificity, round(fp / nullif(tn + fp, 0), 6) as false_positive_rate, round(fn / nullif(tp + fn, 0), 6) as false_safe_rate from k""")
def confusion_automation(spark: SparkSession, d: str) -> DataFrame:
    """What a flag misses and what it raises without need, over all rows."""
    return metrics.automation_rates(table(spark, d, "lineitem"), F.col("l_discount") > 0.05, F.col("l_tax") > 0.04, ["l_returnflag"])


@query("""
with c as (select case_id, min(split) as split, coalesce(min(source), '') as source, min(coalesce(reference_membership, '')) as m, min(coalesce(difficulty, '')) as df, min(coalesce(challenge_class, '')) as cl from identity_e2e_v6_72 group by 1),
e as (select coalesce(split, '') as scope, source as mode, case when upper(m) = 'MATCH' then 'MATCH' else 'NO_MATCH' end as t, case when df = 'hard' then 'REVIEW' when cl like '%salt%' then 'MATCH' else 'NO_MATCH' end as p from c)
select case when grouping(scope) = 1 then 'ALL' else scope end as scope, case when grouping(mode) = 1 then 'ALL' else mode end as mode, count(*) as n, round(count(*) filter (p <> 'REVIEW') / count(*), 6) as coverage, round(count(*) filter (p <> 'REVIEW' and p = t) / nullif(count(*) filter (p <> 'REVIEW'), 0), 6) as selective_accuracy from e group by cube (e.scope, e.mode)""")
def selective_by_scope(spark: SparkSession, d: str) -> DataFrame:
    """Coverage and accuracy where decided, by split, source, both and overall."""
    from .evaluation import _cases

    return metrics.by_scope_and_mode(_cases(spark, d), "split", "source", F.col("truth"), F.col("pred"))


@query("""
with r as (select event_type, user_id % 7 as g, avg(value) as v, max(event_id) as k, min(case when event_id % 3 = 0 then event_id end) as note from events group by 1, 2)
select event_type, count(*) as n, round(avg(v), 6) as v_mean, round(coalesce(stddev_samp(v), 0), 6) as v_std, arg_min(note, k) filter (note is not null) as note from r group by 1""")
def repeats_with_notes(spark: SparkSession, d: str) -> DataFrame:
    """Mean and spread over repeats, with the first note there is."""
    r = table(spark, d, "events").groupBy("event_type", (F.col("user_id") % 7).alias("g")).agg(F.avg("value").alias("v"), F.max("event_id").alias("k"), F.min(F.when(F.col("event_id") % 3 == 0, F.col("event_id"))).alias("note"))
    return metrics.over_repeats(r, ["event_type"], ["v"], ["note"], "k")


@query("""
with f as (select case when text is null then 'NULL_TEXT' when trim(text, ' ') = '' then 'BLANK_TEXT' when lang is null then 'NO_LANGUAGE' end as failure from documents) select failure, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from f where failure is not null group by 1""")
def failure_summary(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with texts, by kind."""
    kind = F.when(F.col("text").isNull(), "NULL_TEXT").when(F.trim("text") == "", "BLANK_TEXT").when(F.col("lang").isNull(), "NO_LANGUAGE")
    return metrics.failures(table(spark, d, "documents"), kind)


@query("""select event_type, count(*) as n_calls, count(*) filter (value > 20) as n_ok, round(coalesce(sum(value) filter (value > 20), 0), 4) as value, round(coalesce(sum(cast(user_id as double)) filter (value > 20), 0), 4) as user_id from events group by 1""")
def call_usage(spark: SparkSession, d: str) -> DataFrame:
    """Calls and what the good ones used."""
    return metrics.usage(table(spark, d, "events"), ["event_type"], F.col("value") > 20, ["value", "user_id"])


@query("""
select coalesce(source, '') as source, coalesce(round(avg(n_chars) filter (lower(lang) = 'en'), 6), 0) as en, coalesce(round(avg(n_chars) filter (lower(lang) = 'ko'), 6), 0) as ko from documents group by 1""")
def figure_table(spark: SparkSession, d: str) -> DataFrame:
    """Mean lengths by source and language, as a figure takes them."""
    docs = table(spark, d, "documents").select(F.coalesce("source", F.lit("")).alias("source"), F.lower("lang").alias("lang"), "n_chars")
    return metrics.figure_frame(docs, "source", "lang", ["en", "ko"], F.col("n_chars"))


@query("""
with k as (select 'six_per_region' as check_name, count(*) as n_rows, count(*) filter (n <> 5) as n_bad, 'FAIL' as bad from (select count(*) as n from nation group by n_regionkey) union all select 'price_odd', count(*), count(*) filter (p_retailprice > 1500), 'WARN' from part)
select count(*) as n_checks, count(*) filter (n_bad > 0 and bad = 'FAIL') as n_fail, count(*) filter (n_bad > 0 and bad = 'WARN') as n_warn, case when count(*) filter (n_bad > 0 and bad = 'FAIL') > 0 then 'FAIL' when count(*) filter (n_bad > 0 and bad = 'WARN') > 0 then 'WARN' else 'PASS' end as status from k""")
def overall_status(spark: SparkSession, d: str) -> DataFrame:
    """One status of several checks, some of which only warn."""
    return quality.overall(quality.all_checks([quality.equal_counts(table(spark, d, "nation"), "six_per_region", "n_regionkey", 5), quality.warn(table(spark, d, "part"), "price_odd", F.col("p_retailprice") > 1500)]))


@query("""
select 'small' as view, p_type, count(*) as n from part where p_size < 10 group by 2 union all select 'cheap', p_type, count(*) from part where p_retailprice < 1000 group by 2""")
def tagged_views(spark: SparkSession, d: str) -> DataFrame:
    """Two views of the parts on end; some parts are in both."""
    return quality.views(table(spark, d, "part"), {"small": F.col("p_size") < 10, "cheap": F.col("p_retailprice") < 1000}).groupBy("view", "p_type").agg(F.count(F.lit(1)).alias("n"))


@query("""
with r as (select rule_id, threshold_operator || ' ' || threshold_pct || '%' as t from group_rules) select rule_id, case when threshold_operator is null then '' else t end as echoed from r join (select rule_id as k, threshold_operator from group_rules) on rule_id = k""")
def echoed_conditions(spark: SparkSession, d: str) -> DataFrame:
    """Conditions echoed where a rule states one."""
    t = F.concat(F.coalesce("threshold_operator", F.lit("")), F.lit(" "), F.col("threshold_pct").cast("string"), F.lit("%"))
    return table(spark, d, "group_rules").select("rule_id", C.echoed(t, r"^[><]").alias("echoed"))
