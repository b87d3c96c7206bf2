"""Retrieval and extraction quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallspark.operators.scratch import written

#: Buckets that a range of values is cut into, and ranges that are broadcast.
BUCKETS, BROADCAST_ROWS = 1024, 100_000


def recall_and_mrr(found: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """Queries, recall at k and mean reciprocal rank of found (query_id, drawer_id, rank) against gold (query_id, drawer_id)."""
    hits = gold.join(found.where(F.col("rank") <= k), ["query_id", "drawer_id"], "left").groupBy("query_id").agg(F.count("rank").alias("hit"), F.count("*").alias("n"), F.min("rank").alias("first"))
    return hits.agg(F.count("*").alias("queries"), F.round(F.avg(F.col("hit") / F.col("n")), 6).alias("recall"), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


def order_statistics(rows: DataFrame, by: str, value: str, places: list[Column]) -> DataFrame:
    """by, n and values (an array): of each group, its number of values and the values at some places (from 1; expressions of n, which must be within it), exactly.

    No group is sorted or gathered: the range of values that holds a place is cut into BUCKETS buckets, counted by partial sums, and the bucket with the place,
    between its own smallest and largest value, is the next range, until it is one value. Later rounds read only what lies in
    such ranges. Nulls and NaN take no part; groups without a value give no rows; a null group is a group.
    """
    kind = rows.schema[value].dataType.simpleString()
    held = rows.select(F.col(by).alias("_by"), F.col(value).alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan(F.col("_v").cast("double")))
    sizes = held.groupBy("_by").agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    targets = written(sizes.select("_by", "n", "lo", "hi", F.posexplode(F.array(*(p.cast("long") for p in places))).alias("which", "at")), "targets")
    same = lambda a, b: F.col(f"{a}._by").eqNullSafe(F.col(f"{b}._by"))
    while True:
        ranges = targets.where("lo < hi").select("_by", "lo", "hi").distinct()
        n = ranges.count()
        if not n:
            break
        few = F.broadcast if n <= BROADCAST_ROWS else lambda df: df
        inside = held.alias("h").join(few(ranges.alias("r")), same("h", "r") & (F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi"))).select("h._by", "_v", "lo", "hi")
        part = lambda c: F.col(c).cast("double") / 2
        width = part("hi") - part("lo")
        bucket = F.when(F.col("_v") == F.col("lo"), 0).when(F.col("_v") == F.col("hi"), BUCKETS - 1).when((width > 0) & (width < float("inf")), F.least(F.lit(BUCKETS - 1), F.floor((part("_v") - part("lo")) / width * BUCKETS).cast("int"))).otherwise(BUCKETS // 2)
        counts = inside.withColumn("bucket", bucket).groupBy("_by", "lo", "hi", "bucket").agg(F.count("*").alias("c"), F.min("_v").alias("low"), F.max("_v").alias("high"))
        counts = counts.withColumn("upto", F.sum("c").over(Window.partitionBy("_by", "lo", "hi").orderBy("bucket"))).alias("c")
        found = targets.where("lo < hi").alias("t").join(counts, same("t", "c") & (F.col("t.lo") == F.col("c.lo")) & (F.col("t.hi") == F.col("c.hi")) & (F.col("at") > F.col("upto") - F.col("c")) & (F.col("at") <= F.col("upto")))
        found = found.select("t._by", "n", F.col("low").alias("lo"), F.col("high").alias("hi"), "which", (F.col("at") - F.col("upto") + F.col("c")).alias("at"))
        targets = written(targets.where("not lo < hi").unionByName(found), "targets")
        left = targets.where("lo < hi").select("_by", "lo", "hi").distinct()
        held = written(held.alias("h").join(few(left.alias("r")), same("h", "r") & (F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi")), "left_semi").select("h._by", "_v"), "held")
    out = targets.groupBy("_by").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("which", "lo"))).alias("_all"))
    return out.select(F.col("_by").alias(by), "n", F.transform("_all", lambda x: x["lo"]).cast(f"array<{kind}>").alias("values"))


def nearest_rank(rows: DataFrame, by: str, value: str, shares: list[float], up: bool = False) -> DataFrame:
    """Nearest-rank percentiles of each group (position floor(share * n), or rounded up; at least 1), by selection."""
    places = [F.greatest((F.ceil if up else F.floor)(F.lit(s) * F.col("n")), F.lit(1)) for s in shares]
    found = order_statistics(rows, by, value, places)
    return found.select(by, "n", *(F.col("values")[k].alias(f"p{round(100 * s)}") for k, s in enumerate(shares)))


def confusion(proposed: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """Precision and recall of multisets: equal rows match one to one."""
    p, g = proposed.groupBy(*keys).agg(F.count("*").alias("p")), gold.groupBy(*keys).agg(F.count("*").alias("g"))
    both = p.join(g, keys, "full").select(F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("g", F.lit(0)).alias("g"))
    out = both.agg(F.sum(F.least("p", "g")).alias("matched"), F.sum("p").alias("proposed"), F.sum("g").alias("gold"))
    return out.withColumn("precision", F.round(F.try_divide("matched", "proposed"), 6)).withColumn("recall", F.round(F.try_divide("matched", "gold"), 6))


def quality(results: DataFrame) -> DataFrame:
    """Per category: questions, correct ones, evidence recall, omissions, abstentions and latency (median; nearest rank at 0.95; mean).

    results: category, correct, found, wanted (evidence groups), omissions, abstains (expected), abstained, ms.
    """
    n = F.col("n")
    found = order_statistics(results, "category", "ms", [F.floor((n + 1) / 2), F.ceil((n + 1) / 2), F.greatest(F.floor(F.lit(0.95) * n), F.lit(1))])
    at = lambda k: F.col("values")[k]
    found = found.select(F.col("category").alias("_category"), F.round((at(0) + at(1)) / 2, 1).alias("p50_ms"), F.round(at(2), 1).alias("p95_ms"))
    out = results.groupBy("category").agg(
        F.count("*").alias("n"), F.count_if("correct").alias("correct"), F.round(100 * F.count_if("correct") / F.count("*"), 1).alias("correct_pct"),
        F.round(F.sum("found") / F.greatest(F.sum("wanted"), F.lit(1)), 3).alias("evidence_recall"), F.sum("omissions").alias("omissions"),
        F.count_if("abstains").alias("abstention_total"), F.count_if(F.col("abstains") & F.col("abstained")).alias("abstention_correct"), F.round(F.avg("ms"), 1).alias("mean_ms"),
    )
    return out.join(found, F.col("category").eqNullSafe(F.col("_category")), "left").drop("_category")


def connectivity(statements: DataFrame, entities: DataFrame, phrase: str, roles: list[str]) -> DataFrame:
    """Entities, those that read like phrases (a pattern), those linked to another that does not, roles held under several names, and ASCII names."""
    real = entities.select("entity_id").distinct().withColumn("_phrase", F.col("entity_id").rlike(phrase))
    named = real.where("not _phrase").select("entity_id")
    ends = statements.where("subject_id <> object_id").select("subject_id", "object_id").distinct()
    ends = ends.join(named.withColumnRenamed("entity_id", "subject_id"), "subject_id", "left_semi").join(named.withColumnRenamed("entity_id", "object_id"), "object_id", "left_semi")
    linked = ends.select(F.explode(F.array("subject_id", "object_id")).alias("entity_id")).distinct()
    role = F.split_part("entity_id", F.lit(":"), F.lit(1))
    split = real.where(role.isin(roles)).groupBy(role.alias("role")).agg(F.count("*").alias("c")).where("c > 1")
    ascii_named = named.where(~F.col("entity_id").rlike(r"[^\x00-\x7F]") & ~role.isin(*roles, "self"))
    count = lambda df: df.agg(F.count("*").alias("n")).scalar()
    out = real.agg(F.count("*").alias("entities"), F.count_if("_phrase").alias("phrase_nodes")).withColumn("linked", count(linked))
    out = out.withColumn("linked_pct", F.round(100 * F.col("linked") / F.greatest(F.col("entities") - F.col("phrase_nodes"), F.lit(1)), 1))
    return out.withColumn("fragmented_roles", count(split)).withColumn("ascii_named", count(ascii_named))


# fixed values: what the shadow proposer has to reach, at least or at most
SHADOW_LEAST = {"operation_accuracy": 0.90, "action_exact_accuracy": 0.80, "target_top1_accuracy": 0.90, "case_consistency_rate": 0.95}
SHADOW_MOST = {"none_false_positive_rate": 0.05, "schema_failure_rate": 0.0, "provider_failure_rate": 0.0, "policy_rejection_rate": 0.0, "high_confidence_errors": 0.0}


def shadow_scores(runs: DataFrame) -> DataFrame:
    """Rates, stability and gates of a commitment proposer over runs (name, error, expected and actual operation, action, target, confidence).

    A run is right if it has no error and operation, action and target (where expected) agree. A case is consistent if all its
    runs come out alike. overall_pass needs every gate, cases of each kind among them.
    """
    ok = F.col("error").isNull()
    same = lambda c: F.coalesce(F.col(f"actual_{c}"), F.lit("")) == F.coalesce(F.col(f"expected_{c}"), F.lit(""))
    has = lambda c: F.coalesce(F.col(f"expected_{c}") != "", F.lit(False))
    right = ok & same("operation") & (~has("action") | same("action")) & (~has("target") | same("target"))
    none = F.col("expected_operation") == "none"
    rate = lambda part, whole: F.round(F.coalesce(F.try_divide(F.count_if(part), F.count_if(whole)), F.lit(0.0)), 6)
    outcome = F.concat_ws("|", F.coalesce("error", F.lit("")), F.coalesce("actual_operation", F.lit("")), F.coalesce("actual_action", F.lit("")), F.coalesce("actual_target", F.lit("")))
    rows = runs.withColumn("_right", right)
    cases = rows.groupBy("name").agg((F.min(outcome) == F.max(outcome)).alias("same"), F.min("_right").alias("right"), F.count("*").alias("runs"))
    cases = cases.agg(F.count("*").alias("cases"), F.min("runs").alias("min_runs"), F.round(F.avg(F.col("same").cast("int")), 6).alias("case_consistency_rate"), F.round(F.avg(F.col("right").cast("int")), 6).alias("all_runs_correct_rate"))
    every = F.lit(True)
    out = rows.agg(
        F.count("*").alias("total"), F.count_if(ok).alias("valid"),
        rate(ok & same("operation"), ok).alias("operation_accuracy"), rate(ok & has("action") & same("action"), ok & has("action")).alias("action_exact_accuracy"),
        rate(ok & has("target") & same("target"), ok & has("target")).alias("target_top1_accuracy"), rate(ok & none & ~same("operation"), ok & none).alias("none_false_positive_rate"),
        rate(F.col("error") == "schema_invalid", every).alias("schema_failure_rate"), rate(F.col("error").isin("provider_error", "provider_empty"), every).alias("provider_failure_rate"), rate(F.col("error") == "policy_rejected", every).alias("policy_rejection_rate"),
        F.count_if(ok & (F.col("confidence") >= 0.8) & ~F.col("_right")).cast("double").alias("high_confidence_errors"),
        F.count_if(ok & has("action")).alias("action_cases"), F.count_if(ok & has("target")).alias("target_cases"), F.count_if(ok & none).alias("none_cases"),
    )
    for c in ("cases", "min_runs", "case_consistency_rate", "all_runs_correct_rate"):
        out = out.withColumn(c, cases.select(c).scalar())
    gates = [F.col(c) >= x for c, x in SHADOW_LEAST.items()] + [F.col(c) <= x for c, x in SHADOW_MOST.items()] + [F.col(c) > 0 for c in ("action_cases", "target_cases", "none_cases")] + [F.col("min_runs") >= 2]
    passed = F.lit(0)
    for g in gates:
        passed = passed + g.cast("int")
    return out.withColumn("gates_passed", passed).withColumn("overall_pass", (F.col("total") > 0) & (passed == len(gates)))


# fixed values: the least that extraction has to reach, by what is extracted
GATES = {"triple": (0.85, 0.70), "invalidation": (0.90, 0.80)}


def extraction_gates(proposed: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """Per kind: matched, proposed and gold rows as multisets, precision, recall, and whether they pass the kind's gates (none: they pass)."""
    p, g = proposed.groupBy("kind", *keys).agg(F.count("*").alias("p")), gold.groupBy("kind", *keys).agg(F.count("*").alias("g"))
    both = p.join(g, ["kind", *keys], "full").select("kind", F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("g", F.lit(0)).alias("g"))
    out = both.groupBy("kind").agg(F.sum(F.least("p", "g")).alias("matched"), F.sum("p").alias("proposed"), F.sum("g").alias("gold"))
    out = out.withColumn("precision", F.round(F.try_divide("matched", "proposed"), 6)).withColumn("recall", F.round(F.try_divide("matched", "gold"), 6))
    passed = F.lit(True)
    for kind, (least_p, least_r) in GATES.items():
        passed = F.when(F.col("kind") == kind, (F.coalesce("precision", F.lit(0.0)) >= least_p) & (F.coalesce("recall", F.lit(0.0)) >= least_r)).otherwise(passed)
    return out.withColumn("passed", passed)
