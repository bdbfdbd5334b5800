"""Queries of the text problems (1, 2, 6, 8, 9, 10) with their SQL twins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, table
from . import dedupe, mixing, mojibake, overlap, tokens, truncation


def _overlaps(spark: SparkSession, d: str) -> DataFrame:
    train = overlap.substances(table(spark, d, "broad_salt_validation_cases"), "case_id", "chemical_name", "cas")
    evaluation = overlap.substances(table(spark, d, "identity_e2e_v6_72"), "case_id", "candidate_name", "candidate_cas")
    return overlap.overlaps(train, evaluation)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a training case and an evaluation case on the same substance."""
    return _overlaps(spark, d).select(F.col("train_id").alias("case_id_a"), F.col("eval_id").alias("case_id_b"))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping pairs and affected evaluation cases per split and source."""
    cases = table(spark, d, "identity_e2e_v6_72").select(F.col("case_id").alias("eval_id"), "split", "source").dropDuplicates(["eval_id"])
    per = _overlaps(spark, d).groupBy("eval_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("slips") > 0).alias("with_slip"))
    return cases.join(per, "eval_id").groupBy("split", "source").agg(F.sum("n").alias("n_pairs"), F.sum("with_slip").alias("n_with_slip"), F.count(F.lit(1)).alias("n_eval_cases"))


GARBLED = [
    ("broad_salt_rules_curated_13", "rule_id", ["regulatory_source", "notes"]),
    ("broad_salt_validation_cases", "case_id", ["notes"]),
]


def _garbled(spark: SparkSession, d: str) -> DataFrame:
    rows = [
        table(spark, d, name).select(F.lit(name).alias("table_name"), F.col(key).cast("string").alias("record_id"), F.lit(field).alias("field_name"), F.col(field).cast("string").alias("text")).filter(F.col("record_id").isNotNull())
        for name, key, fields in GARBLED
        for field in fields
    ]
    rows = reduce(DataFrame.unionByName, rows)
    return mojibake.garbled(rows, mojibake.fit(rows, "text"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Fields that hold garbled text."""
    return _garbled(spark, d).select("table_name", "record_id", "field_name")


def p2_restored(spark: SparkSession, d: str) -> DataFrame:
    """Garbled fields with the restored text, null where bytes were lost, and the encoding pairs."""
    return _garbled(spark, d)


COPIED = [
    ("broad_salt_validation_cases", "case_id", "rule_id", "chemical_name", "cas", "reference_membership"),
    ("chemical_group_candidates_seed", "seed_id", "target_rule_id", "candidate_name", "candidate_cas", "gold_label"),
]


def _records(spark: SparkSession, d: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [dedupe.records(table(spark, d, t[0]), *t) for t in COPIED])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Ids that repeat the record of a smaller id."""
    return dedupe.copies(_records(spark, d))


def p6_records(spark: SparkSession, d: str) -> DataFrame:
    """One row per record with the number of its copies."""
    return dedupe.collapsed(_records(spark, d))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encoded(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("record_id", "doc_id")


def p8_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Documents, tokens and exact round trips by source and language."""
    docs = table(spark, d, "documents").withColumn("lang", F.lower("lang"))
    per = tokens.sizes(docs, "doc_id", "text", ["source", "lang"], back=True)
    return per.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.count_if("same").alias("n_round_trip"))


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sizes = cut(tokens.sizes(table(spark, d, "documents"), "doc_id", "text", ["source"]).drop("same"))
    planned = mixing.plan(sizes, table(spark, d, "mix_targets"))
    return mixing.repeats(sizes, planned), planned


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mixture: every copy of every document drawn, in shuffled order."""
    counted, _ = _mixed(spark, d)
    return mixing.mixture(counted).withColumnRenamed("record_id", "doc_id")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual shares of the sources."""
    return mixing.shares(*_mixed(spark, d))


def _truncated(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return truncation.truncated(docs, "doc_id", "text", "lang").withColumnRenamed("record_id", "doc_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents cut off before their end."""
    return _truncated(spark, d).filter("cut").select("doc_id").distinct()


def p10_report(spark: SparkSession, d: str) -> DataFrame:
    """Share of cut documents per source, of those that aren't blank."""
    docs = table(spark, d, "documents").select("doc_id", "source").dropDuplicates(["doc_id"])
    per = _truncated(spark, d).select("doc_id", "cut").dropDuplicates(["doc_id"]).join(docs, "doc_id")
    return per.groupBy("source").agg(F.count(F.lit(1)).alias("n_texts"), F.count_if("cut").alias("n_cut")).withColumn("rate", F.round(F.col("n_cut") / F.col("n_texts"), 6))


QUERIES = {q.__name__: q for q in (p1_found, p1_report, p2_found, p2_restored, p6_found, p6_records, p8_ids, p8_sizes, p9_mix, p9_shares, p10_found, p10_report)}
SQL: dict[str, str] = {}
