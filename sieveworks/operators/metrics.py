"""Evaluation statistics as single-pass aggregates.

The confusion variants differ in their population, in what abstention counts
as, and in what an undefined rate is; they are kept apart on purpose.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z95 = 1.959963984540054
#: Pairs from which on the terms of the exact test are derived from one another.
MANY = 100_000


def ratio(a: Column, b: Column, undefined: float | None = None) -> Column:
    r = F.round(F.try_divide(a.cast("double"), b.cast("double")), 6)
    return r if undefined is None else F.coalesce(r, F.lit(undefined))


def cells(df: DataFrame, truth: Column, pred: Column, by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, tn of decided rows, n_review of abstentions, n_total; truth and pred are MATCH, NO_MATCH or REVIEW."""
    hit = lambda t, p: F.count_if((truth == t) & (pred == p))
    return df.groupBy(*by).agg(
        hit("MATCH", "MATCH").alias("tp"), hit("NO_MATCH", "MATCH").alias("fp"), hit("MATCH", "NO_MATCH").alias("fn"), hit("NO_MATCH", "NO_MATCH").alias("tn"),
        F.count_if(pred == "REVIEW").alias("n_review"), F.count_if((pred == "REVIEW") & (truth == "MATCH")).alias("review_match"), F.count(F.lit(1)).alias("n_total"),
    )


def binary_rates(c: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """All decided rows: precision, recall, f1 and accuracy, undefined ones null."""
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select(*by, "tp", "fp", "fn", "tn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"))


def selective_rates(c: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Decided rows against all: coverage, accuracy where decided, share left for review."""
    decided = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return c.select(*by, decided.alias("n_decided"), ratio(decided, F.col("n_total")).alias("coverage"), ratio(F.col("tp") + F.col("tn"), decided).alias("selective_accuracy"), ratio(F.col("n_review"), F.col("n_total")).alias("review_share"))


def balanced_rates(c: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Decided rows for the rates, all rows for overall_correct; balanced accuracy is the mean of those defined."""
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    rec, spec = F.try_divide(tp.cast("double"), tp + fn), F.try_divide(tn.cast("double"), tn + fp)
    return c.select(*by, F.round(rec, 6).alias("recall"), F.round(spec, 6).alias("specificity"), F.round((F.coalesce(rec, spec) + F.coalesce(spec, rec)) / 2, 6).alias("balanced_accuracy"), ratio(tp + tn, F.col("n_total")).alias("overall_correct"))


def strict_rates(c: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """All rows: a match left for review is a miss; undefined rates are 0."""
    tp, fp, tn = (F.col(x) for x in ("tp", "fp", "tn"))
    fn = F.col("fn") + F.col("review_match")
    return c.select(*by, fn.alias("fn_all"), ratio(tp, tp + fp, 0.0).alias("precision"), ratio(tp, tp + fn, 0.0).alias("recall"), ratio(tp + tn, F.col("n_total"), 0.0).alias("accuracy"), ratio(F.col("n_review"), F.col("n_total"), 0.0).alias("review_rate"))


def automation_rates(df: DataFrame, truth: Column, flagged: Column, by: Sequence[str] = ()) -> DataFrame:
    """All rows by two truth values, null is false: what was missed, what was flagged without need, and the rates."""
    t, p = F.coalesce(truth, F.lit(False)), F.coalesce(flagged, F.lit(False))
    k = df.groupBy(*by).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return k.select(*by, fn.alias("false_safe"), fp.alias("over_screening"), ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ratio(tn, tn + fp).alias("specificity"), ratio(fp, tn + fp).alias("false_positive_rate"), ratio(fn, tp + fn).alias("false_safe_rate"))


def by_scope_and_mode(df: DataFrame, scope: str, mode: str, truth: Column, pred: Column) -> DataFrame:
    """(scope, mode, n, coverage, selective_accuracy), with ALL for each and both, from one pass of grouping sets."""
    decided = pred != "REVIEW"
    rows = df.select(F.coalesce(scope, F.lit("")).alias("scope"), F.coalesce(mode, F.lit("")).alias("mode"), decided.cast("int").alias("_d"), (decided & (truth == pred)).cast("int").alias("_r"))
    per = rows.cube("scope", "mode").agg(F.count(F.lit(1)).alias("n"), F.sum("_d").alias("_d"), F.sum("_r").alias("_r"), F.grouping("scope").alias("_s"), F.grouping("mode").alias("_m"))
    name = lambda c, g: F.when(F.col(g) == 1, "ALL").otherwise(F.col(c)).alias(c)
    return per.select(name("scope", "_s"), name("mode", "_m"), "n", ratio(F.col("_d"), F.col("n")).alias("coverage"), ratio(F.col("_r"), F.col("_d")).alias("selective_accuracy"))


def over_repeats(df: DataFrame, by: Sequence[str], values: Sequence[str], noted: Sequence[str], order: str) -> DataFrame:
    """(by.., n, mean and std of each value, noted..): a single repeat has no spread; of what is noted the first that isn't null counts."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c)
    stats = [x for v in values for x in (F.round(F.avg(v), 6).alias(f"{v}_mean"), F.round(F.coalesce(F.stddev_samp(v), F.lit(0.0)), 6).alias(f"{v}_std"))]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *stats, *[first(c) for c in noted])


def failures(df: DataFrame, kind: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by.., failure, n, share): failures by kind, a null kind is none; the most frequent first."""
    per = df.withColumn("failure", kind).filter("failure is not null").groupBy(*by, "failure").agg(F.count(F.lit(1)).alias("n"))
    total = per.agg(F.sum("n").alias("_all"))
    return per.crossJoin(F.broadcast(total)).select(*by, "failure", "n", ratio(F.col("n"), F.col("_all")).alias("share")).orderBy(F.desc("n"), *by, "failure")


def usage(calls: DataFrame, by: Sequence[str], ok: Column, amounts: Sequence[str]) -> DataFrame:
    """(by.., n_calls, n_ok, sum of each amount over good calls); amounts that are no numbers count as missing."""
    good = F.coalesce(ok, F.lit(False))
    return calls.groupBy(*by).agg(F.count(F.lit(1)).alias("n_calls"), F.count_if(good).alias("n_ok"), *[F.round(F.coalesce(F.sum(F.when(good, F.col(a).cast("string").try_cast("double"))), F.lit(0.0)), 4).alias(a) for a in amounts])


def figure_frame(df: DataFrame, row: str, column: str, values: Sequence[str], amount: Column) -> DataFrame:
    """Mean of an amount by row and the named columns, absent cells 0, sorted by row."""
    return df.groupBy(row).pivot(column, list(values)).agg(F.round(F.avg(amount), 6)).fillna(0.0).orderBy(row)


def retrieval_rates(df: DataFrame, truth: Column, pred: Column, by: Sequence[str] = ()) -> DataFrame:
    """Outcomes of target ids: NOT_FOUND and REVIEW are answers too, review is never right."""
    absent, none = truth == "NOT_FOUND", pred == "NOT_FOUND"
    found = (pred != "NOT_FOUND") & (pred != "REVIEW")
    per = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if((truth == pred) & (pred != "REVIEW")).alias("n_correct"), F.count_if(found & ~absent & (truth != pred)).alias("wrong_target"),
        F.count_if(none & ~absent).alias("false_not_found"), F.count_if(found & absent).alias("false_found"), F.count_if(none & absent).alias("_nn"), F.count_if(none).alias("_pn"), F.count_if(absent).alias("_tn"),
    )
    return per.withColumns({"accuracy": ratio(F.col("n_correct"), F.col("n_total")), "not_found_precision": ratio(F.col("_nn"), F.col("_pn")), "not_found_recall": ratio(F.col("_nn"), F.col("_tn"))}).drop("_nn", "_pn", "_tn")


def per_label(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """(label, tp, n_true, n_pred) of rows where both are there, over the union of labels."""
    ok = df.filter((F.coalesce(F.col(truth), F.lit("")) != "") & (F.coalesce(F.col(pred), F.lit("")) != ""))
    both = ok.groupBy(truth, pred).agg(F.count(F.lit(1)).alias("n"))
    a = both.select(F.col(truth).alias("label"), F.when(F.col(truth) == F.col(pred), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("t"), F.lit(0).alias("p"))
    b = both.select(F.col(pred).alias("label"), F.lit(0).alias("tp"), F.lit(0).alias("t"), F.col("n").alias("p"))
    return a.unionByName(b).groupBy("label").agg(*[F.sum(x).cast("long").alias(y) for x, y in (("tp", "tp"), ("t", "n_true"), ("p", "n_pred"))])


def macro_f1(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """(n, accuracy, macro_f1, n_labels); a label without any right answer has f1 0."""
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("n_true") + F.col("n_pred")), F.lit(0.0))
    return per_label(df, truth, pred).agg(F.sum("n_true").alias("n"), F.round(F.try_divide(F.sum("tp"), F.sum("n_true")), 6).alias("accuracy"), F.round(F.avg(f1), 6).alias("macro_f1"), F.count(F.lit(1)).alias("n_labels"))


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa over rows where both raters answered; null where chance agreement is all."""
    per = per_label(df, a, b).agg(F.sum("n_true").alias("n"), F.sum("tp").alias("_agree"), F.sum(F.col("n_true").cast("double") * F.col("n_pred")).alias("_pairs"))
    po, pe = F.col("_agree") / F.col("n"), F.col("_pairs") / (F.col("n").cast("double") * F.col("n"))
    return per.select("n", F.round(po, 6).alias("observed"), F.round(pe, 6).alias("expected"), F.when(F.abs(1 - pe) > 1e-12, F.round((po - pe) / (1 - pe), 6)).alias("kappa"))


def mcnemar_p(only_a: Column, only_b: Column) -> Column:
    """Exact two-sided probability of the discordant pairs; 1 without any.

    Binomial terms by their logarithms up to 100,000 pairs. From there on the
    largest term of the tail by Stirling's series, and the others each from the
    one above it, down to those that are less than 1e-40 of it.
    """
    n, k = only_a + only_b, F.least(only_a, only_b)
    log_fact = lambda x: F.expr("0D") + _log_gamma(x + 1)
    term = lambda i: F.exp(log_fact(n) - log_fact(i) - log_fact(n - i) - n * F.lit(math.log(2.0)))
    upto = F.least(k, F.lit(MANY // 2).cast("long"))  # k itself wherever it is used, as then n <= MANY
    few = F.aggregate(F.sequence(F.lit(0).cast("long"), upto), F.lit(0.0), lambda s, i: s + term(i))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.when(n <= MANY, few).otherwise(_many_pairs(n, k))))


def _many_pairs(n: Column, k: Column) -> Column:
    """The binomial tail up to k <= n / 2 of many pairs at one half."""
    m, i = n.cast("double"), k.cast("double")
    # as differences from the half, so that nothing is lost between large logarithms
    d = (n - 2 * k) / m
    spread = m / 2 * ((1 - d) * F.log1p(-d) + (1 + d) * F.log1p(d))
    rest = lambda x: 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3.0)))
    top = F.exp(rest(m) - rest(i) - rest(m - i) - spread) * F.sqrt(m / (2 * math.pi * i * (m - i)))
    # a term j below the top is less than exp(-2 j (j - 1) / n) of it
    below = F.sequence(F.lit(0).cast("long"), F.ceil(7 * F.sqrt(m)))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(s: Column, j: Column) -> Column:
        next_ = s["term"] * F.greatest(k - j, F.lit(0)) / (m - (k - j) + 1)
        return F.struct(next_.alias("term"), (s["sum"] + next_).alias("sum"))

    # below a quarter of all, every term is less than exp(-n / 8), which is 0
    return F.when(k * 4 < n, 0.0).otherwise(top * F.aggregate(below, start, add, lambda s: s["sum"]))


def _log_gamma(x: Column) -> Column:
    """ln of the gamma function by Stirling's series after a shift of eight."""
    y = x.cast("double") + 8
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3.0))) + 1 / (1260 * F.pow(y, F.lit(5.0)))
    shift = F.log(F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(1.0), lambda p, i: p * (x.cast("double") + i)))
    return series - shift


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """Lower and upper bound of a share at 95 %, within 0 and 1; null without rows."""
    p, m = k.cast("double") / n, n.cast("double")
    mid, half = p + Z95 * Z95 / (2 * m), Z95 * F.sqrt(p * (1 - p) / m + Z95 * Z95 / (4 * m * m))
    scale = 1 + Z95 * Z95 / m
    bound = lambda x: F.when(n > 0, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x / scale)), 6))
    return bound(mid - half), bound(mid + half)


def with_total(df: DataFrame, by: str) -> DataFrame:
    """(by, n, share) and a TOTAL row, from one rollup."""
    per = df.groupBy(F.coalesce(F.col(by), F.lit("")).alias(by)).agg(F.count(F.lit(1)).alias("n"))
    rolled = per.rollup(by).agg(F.sum("n").alias("n"), F.grouping(by).alias("_all"))
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    return rolled.crossJoin(total).select(F.when(F.col("_all") == 1, "TOTAL").otherwise(F.col(by)).alias(by), "n", F.round(F.try_divide(F.col("n"), F.col("_total")), 6).alias("share"))
