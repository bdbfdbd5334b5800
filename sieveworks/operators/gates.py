"""Deterministic gates: group membership, mixtures, and the target a query stands for.

A gate decides only what its tables tell for sure; the rest is REVIEW, with a
reason. All are equi-joins on keys that are made unique first; null keys match
nothing. Rules that a structure toolkit would decide come in as tables.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import screen


def group_gate(cases: DataFrame, members: DataFrame, rule: str, number: str, fallback: Mapping[str, tuple[Column | None, Column | None, str]] | None = None) -> DataFrame:
    """cases with ``gate`` and ``gate_reason``.

    members: (rule, number) of the registry. A member of the case's group is a
    MATCH, one of other groups only a NO_MATCH; else the rule's fallback
    (condition for MATCH, condition for NO_MATCH, reason of review) decides;
    a null condition doesn't hold.
    """
    known = members.select(F.col(rule).alias("_rule"), F.col(number).alias("_number")).dropna().distinct()
    anywhere = known.select("_number").distinct().withColumn("_any", F.lit(True))
    here = known.withColumn("_here", F.lit(True))
    met = cases.join(here, (F.col(rule) == F.col("_rule")) & (F.col(number) == F.col("_number")), "left").drop("_rule", "_number")
    met = met.join(anywhere, F.col(number) == F.col("_number"), "left").drop("_number")
    decided = [F.when(F.col("_here"), _gate("MATCH", "CAS_IN_TARGET_GROUP")), F.when(F.col("_any"), _gate("NO_MATCH", "CAS_ONLY_IN_OTHER_GROUP"))]
    for name, (yes, no, reason) in (fallback or {}).items():
        mine = F.col(rule) == name
        if yes is not None:
            decided.append(F.when(mine & yes, _gate("MATCH", "FALLBACK_MATCH")))
        if no is not None:
            decided.append(F.when(mine & no, _gate("NO_MATCH", "FALLBACK_NO_MATCH")))
        decided.append(F.when(mine, _gate("REVIEW", reason)))
    out = met.withColumn("_g", F.coalesce(*decided, _gate("REVIEW", "NO_DETERMINISTIC_RULE")))
    return out.withColumns({"gate": F.col("_g.gate"), "gate_reason": F.col("_g.reason")}).drop("_here", "_any", "_g")


def _gate(gate: str, reason: str) -> Column:
    return F.struct(F.lit(gate).alias("gate"), F.lit(reason).alias("reason"))


def mixture_gate(gated: DataFrame, share: Column, limit: Column, operator: Column) -> DataFrame:
    """``group_gate``'s result with the mixture's decision: members count from the limit on; a missing share or limit is for review."""
    meets = screen.meets(share, limit, operator)
    decision = F.when(F.col("gate") != "MATCH", F.col("gate")).when(meets.isNull(), "REVIEW").when(meets, "MATCH").otherwise("NO_MATCH")
    return gated.withColumn("decision", decision)


def element_present(structure: Column, symbol: str) -> Column:
    """Whether a structure string names the element; null for blank."""
    s = F.trim(structure)
    return F.when(F.length(s) > 0, s.rlike(f"(?<![A-Za-z]){symbol}(?![a-z])"))


def retrieval_gate(queries: DataFrame, catalog: DataFrame, structure_hits: DataFrame | None = None) -> DataFrame:
    """(query_id, gate_status, gate_target_id, gate_reason) of each query.

    queries: (query_id, numbers array). catalog: (target_id, kind, numbers
    array) where kind is ``member`` for numbers that each stand for the target
    and ``components`` for those that do so together. Several numbers are found
    by the target whose components they are exactly; one number by the only
    target it stands for, else by the only target in structure_hits (query_id,
    target_id). Anything else is for review.
    """
    q = queries.select("query_id", F.array_sort(F.array_distinct(F.coalesce("numbers", F.array().cast("array<string>")))).alias("numbers")).dropDuplicates(["query_id"])
    sets = catalog.filter("kind = 'components' and size(numbers) > 0").select(F.array_sort(F.array_distinct("numbers")).alias("numbers"), "target_id").groupBy("numbers").agg(F.count_distinct("target_id").alias("n"), F.min("target_id").alias("one"))
    singles = catalog.filter("kind = 'member'").select(F.explode("numbers").alias("number"), "target_id").groupBy("number").agg(F.count_distinct("target_id").alias("n"), F.min("target_id").alias("one"))
    found = lambda reason: (F.lit("FOUND"), F.col("one"), F.lit(reason))
    review = lambda reason: (F.lit("REVIEW"), F.lit(""), F.lit(reason))
    shape = lambda cases: [F.coalesce(*[F.when(c, x[i]) for c, x in cases]).alias(n) for i, n in enumerate(("gate_status", "gate_target_id", "gate_reason"))]
    many = q.filter("size(numbers) > 1").join(sets, "numbers", "left").select(
        "query_id", *shape([(F.col("n") == 1, found("EXACT_MIXTURE_COMPONENT_CAS_SET")), (F.lit(True), review("NO_UNIQUE_EXACT_MIXTURE_COMPONENT_SET"))])
    )
    none = q.filter("size(numbers) = 0").select("query_id", *shape([(F.lit(True), review("CAS_INPUT_UNRESOLVED"))]))
    single = q.filter("size(numbers) = 1").select("query_id", F.col("numbers")[0].alias("number")).join(singles, "number", "left")
    if structure_hits is None:
        single = single.withColumns({"s": F.lit(None).cast("long"), "s_one": F.lit(None).cast("string")})
    else:
        single = single.join(structure_hits.groupBy("query_id").agg(F.count_distinct("target_id").alias("s"), F.min("target_id").alias("s_one")), "query_id", "left")
    by_structure = (F.lit("FOUND"), F.col("s_one"), F.lit("UNIQUE_STRUCTURE_MATCH"))
    cases = [
        (F.col("n") == 1, found("EXACT_CAS_IN_REGULATORY_CATALOG")),
        (F.col("n") > 1, review("CAS_MAPS_TO_MULTIPLE_CATALOG_TARGETS")),
        (F.col("s") == 1, by_structure),
        (F.col("s") > 1, review("MULTIPLE_STRUCTURE_MATCHES")),
        (F.lit(True), review("NO_HIGH_CONFIDENCE_DETERMINISTIC_TARGET")),
    ]
    return many.unionByName(none).unionByName(single.select("query_id", *shape(cases)))


def conflicts(gate: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, gold_target_id, gate_target_id, conflict_type): decisions of the gate that the gold answers contradict."""
    met = gate.filter("gate_status = 'FOUND'").join(gold.select("query_id", "gold_target_id"), "query_id").filter(~F.col("gate_target_id").eqNullSafe(F.col("gold_target_id")))
    kind = F.when(F.col("gold_target_id") == "NOT_FOUND", "GOLD_NOT_FOUND_GATE_FOUND").otherwise("GOLD_AND_GATE_DIFFERENT_TARGET")
    return met.select("query_id", "gold_target_id", "gate_target_id", kind.alias("conflict_type"))


def completeness(calls: DataFrame, wanted: DataFrame, item: str, ok: Column, repeats: int) -> DataFrame:
    """(item, n_ok, n_calls, state) of every wanted item: COMPLETE with exactly ``repeats`` good calls, else MISSING, SHORT or SURPLUS."""
    per = calls.groupBy(item).agg(F.count_if(ok).alias("n_ok"), F.count(F.lit(1)).alias("n_calls"))
    out = wanted.select(item).distinct().join(per, item, "left").fillna(0, ["n_ok", "n_calls"])
    state = F.when(F.col("n_ok") == repeats, "COMPLETE").when(F.col("n_calls") == 0, "MISSING").when(F.col("n_ok") < repeats, "SHORT").otherwise("SURPLUS")
    return out.withColumn("state", state)


def three_systems(cases: DataFrame, answers: DataFrame, item: str, rule: str, by: Sequence[str]) -> DataFrame:
    """(item, by.., system, prediction, available): the rule's, the model's and the hybrid's answer of each case for each model and repeat.

    answers: (item, by.., prediction, valid). The hybrid takes the model's
    answer where the rule abstains (null); ``available`` where the model gave a
    valid answer, so that the systems can be compared on the same cases.
    """
    runs = answers.select(*by).distinct()
    frame = cases.select(item, F.col(rule).alias("_rule")).crossJoin(F.broadcast(runs))  # as many runs as models and repeats
    met = frame.join(answers.select(item, *by, F.col("prediction").alias("_model"), F.col("valid").alias("_valid")).dropDuplicates([item, *by]), [item, *by], "left")
    ok = F.coalesce("_valid", F.lit(False))
    model = F.when(ok, F.col("_model"))
    rows = F.array(*[F.struct(F.lit(n).alias("system"), c.alias("prediction")) for n, c in (("RULE", F.col("_rule")), ("MODEL", model), ("HYBRID", F.coalesce("_rule", model)))])
    return met.select(item, *by, ok.alias("available"), F.explode(rows).alias("_s")).select(item, *by, "_s.system", "_s.prediction", "available")
