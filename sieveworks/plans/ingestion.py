"""Sources, text grammars and streams over the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, table
from ..sources import blocks, tables
from ..streaming import screening as live
from .registry import Registry

R = Registry()
query = R.query
QUERIES, SQL = R.queries, R.sql


@query(r"""
with r as (select payload as p from rule_file_records), b as (select regexp_replace(regexp_replace(p, '^[\s\x{85}\x{a0}\x{feff}]+', ''), '[\s\x{85}\x{a0}\x{feff}]+$', '') as p from r where p is not null), v as (select p from b where json_valid(p)),
t as (select replace(replace(fullkey, '"', ''), '$.', '$.') as path, case when type = 'OBJECT' then 'object' else 'scalar' end as kind from v, json_tree(v.p) where type not in ('NULL', 'ARRAY'))
select path, kind, count(*) as n from t group by 1, 2""")
def json_walk(spark: SparkSession, d: str) -> DataFrame:
    """Paths of the payload trees with the number of values."""
    f = table(spark, d, "rule_file_records").withColumn("rid", F.concat_ws(":", "feed_id", "file_seq", "line_no"))
    return tables.walk_json(f, "rid", "payload").groupBy("path", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(r"""
with m as (select doc_id, regexp_replace(regexp_replace(text, '(^|[^\d-])(\d{2,4}-\d-\d{1,6})($|[^\d-])', '\1' || chr(1) || '\2' || chr(2) || '\3', 'g'), '(^|[^\d\x01-])(\d{2,4}-\d-\d{1,6})($|[^\d-])', '\1' || chr(1) || '\2' || chr(2) || '\3', 'g') as t from documents where text is not null),
b as (select doc_id, unnest(string_split(t, chr(1))[2:]) as x, generate_subscripts(string_split(t, chr(1))[2:], 1) as block from m),
n as (select doc_id, block, split_part(x, chr(2), 1) as code, list_distinct(regexp_extract_all(split_part(x, chr(2), 2), '(?:^|[^0-9])(\d{2,7}-\d{2}-\d)(?:[^0-9]|$)', 1)) as ns from b)
select doc_id, cast(block as integer) as block, code, unnest(case when len(ns) = 0 then [null] else ns end) as number from n""")
def designation_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Codes of each text with the numbers that follow them."""
    return blocks.designation_pairs(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("record_id", "doc_id")


@query(r"""
with m as (select doc_id, regexp_extract_all(text, '(\d+(?:\.\d+)?)\s*%\s*(이상|초과|이하|미만)') as ms, regexp_extract_all(text, '(\d+(?:\.\d+)?)\s*%\s*(이상|초과|이하|미만)', 1) as v, regexp_extract_all(text, '(\d+(?:\.\d+)?)\s*%\s*(이상|초과|이하|미만)', 2) as w from documents),
u as (select doc_id, unnest(range(0, len(ms))) as ord, v, w from m) select doc_id, cast(ord as integer) as ord, cast(v[ord + 1] as double) as limit_pct, w[ord + 1] as word from u""")
def text_limits(spark: SparkSession, d: str) -> DataFrame:
    return blocks.limits(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("record_id", "doc_id")


@query("""
with r as (select distinct on (rule_id) rule_id as k, cast(threshold_pct as double) as t from group_rules)
select 'all' as part, count(*) as n, count(t) as n_with_rule from (select upper(trim(target_rule_id, ' ')) as k from chemical_group_candidates_seed) s left join r on s.k = r.k""")
def aliased_columns(spark: SparkSession, d: str) -> DataFrame:
    """Tables of different column names read under one, then looked up."""
    s = tables.with_aliases(table(spark, d, "chemical_group_candidates_seed"), {"k": ["rule_id", "TARGET_RULE_ID"], "absent": ["no_such"]})
    r = tables.with_aliases(table(spark, d, "group_rules"), {"k": ["rule_id"], "t": ["threshold_pct"]}).dropDuplicates(["k"])
    return s.withColumn("k", F.upper(F.trim("k"))).join(r, "k", "left").agg(F.count(F.lit(1)).alias("n"), F.count("t").alias("n_with_rule")).select(F.lit("all").alias("part"), "n", "n_with_rule")


_TRIGGER = "value >= case event_type when 'purchase' then 60 when 'click' then 80 when 'view' then 90 end"


@query(f"""
select time_bucket(interval '1 day', ts) as window_start, event_type, count(*) as n, count(*) filter ({_TRIGGER}) as n_triggered from events group by 1, 2""")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events streamed through a rule table, counted by day and type."""
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    rules = spark.createDataFrame([("purchase", 60.0), ("click", 80.0), ("view", 90.0)], "event_type string, low double")
    hits = live.screened(stream, rules, "event_type", F.col("value") >= F.col("low"))
    per = live.windowed(hits, "ts", "1 day", "event_type", late="30 days")
    out = live.drain_updates(per, f"{shared_dir(spark)}/windows_{uuid.uuid4().hex}")
    return out.groupBy("window_start", "event_type").agg(F.max("n").alias("n"), F.max("n_triggered").alias("n_triggered"))  # counts only grow


@query("""select event_id, event_type, value from events qualify row_number() over (partition by event_id order by ts) = 1""")
def stream_once(spark: SparkSession, d: str) -> DataFrame:
    """Events streamed into files, each id once."""
    schema = table(spark, d, "events").schema
    stream = live.once(spark.readStream.schema(schema).parquet(f"{d}/events.parquet*"), "event_id", "ts", "30 days")
    return live.drain(stream.select("event_id", "event_type", "value"), f"{shared_dir(spark)}/once_{uuid.uuid4().hex}")
