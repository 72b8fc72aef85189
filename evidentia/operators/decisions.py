"""Gates, fit, scores, ranks and backtests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.exprs import clamp, half_even, half_up, ratio

WEIGHTS = (0.25, 0.25, 0.20, 0.15, 0.15)


def blockers(checks: list[tuple[str, Column]]) -> Column:
    """Codes, in order, of the checks that fail; a check that is null fails."""
    return F.array_compact(F.array(*[F.when(F.coalesce(ok, F.lit(False)), F.lit(None)).otherwise(F.lit(code)) for code, ok in checks]))


def eligibility(df: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    b = blockers(checks)
    return df.withColumns({"blocker_codes": F.array_join(b, ","), "eligible": F.size(b) == 0})


# Metrics that a candidate needs.
BASE_METRICS = ("economic_impact_rate", "problem_entity_spread", "problem_mention_rate")
DEMAND_METRIC = "independent_demand_signal_rate"
PAYMENT_METRIC = "direct_payment_evidence_rate"


def opportunity_eligibility(tidy: DataFrame, levels: DataFrame, audits: DataFrame, gates: list[tuple[str, Column]] | None = None) -> DataFrame:
    """cluster, evidence_level, blocker_codes in order, eligible; of clusters that spread over several entities.

    tidy: the metrics of each cluster as (entity, metric, numerator, value, status); levels: cluster, level;
    audits: cluster, verdict of the latest. `gates` are checks of the whole run, such as its quality and
    stability, which come first.
    """
    ok = F.col("status") == "measured"
    positive = ok & (F.col("numerator") > 0) & (F.col("value") > 0)
    of = lambda name, what: F.max(F.when(F.col("metric") == name, what))
    per = tidy.groupBy(F.col("entity").alias("cluster")).agg(
        F.count_if(F.col("metric").isin(*BASE_METRICS) & ok).alias("base"), F.bool_or(F.col("status").isin("insufficient_repetition", "insufficient_entity_spread")).alias("narrow"),
        of(DEMAND_METRIC, ok).alias("demand"), of(DEMAND_METRIC, positive).alias("demand_on"), of(PAYMENT_METRIC, ok).alias("payment"), of(PAYMENT_METRIC, positive).alias("payment_on"),
    )
    j = per.where(~F.col("narrow")).join(levels.select("cluster", "level"), "cluster", "left").join(audits, "cluster", "left")
    level = F.coalesce("level", F.lit("unknown"))
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    codes = [F.when(~F.coalesce(good, F.lit(False)), F.lit(code)) for code, good in gates or []]
    codes += [
        F.when(F.col("verdict").isNull(), "missing_cluster_audit").when(F.col("verdict") != "coherent", F.concat(F.lit("cluster_audit:"), "verdict")),
        F.when(F.col("base") < len(BASE_METRICS), "base_metrics_not_measured"),
        F.when(level != "E2", "independent_source_evidence_required"),
        F.when(no("demand"), "independent_demand_evidence_required").when(no("demand_on"), "independent_demand_signal_absent"),
        F.when(no("payment"), "direct_payment_evidence_required").when(no("payment_on"), "direct_payment_signal_absent"),
    ]
    found = F.array_compact(F.array(*codes))
    return j.select("cluster", level.alias("evidence_level"), F.array_join(found, ",").alias("blocker_codes"), (F.size(found) == 0).alias("eligible"))


def score(df: DataFrame, metrics: list[str], weights=WEIGHTS, least_confidence: float = 0.6) -> DataFrame:
    """Potential, confidence and total of each row.

    For metric m the row has m_value (null if not measured), m_low, m_high and m_n; and fit, level, blocked.
    """
    k = len(metrics)
    add = lambda xs: sum(xs[1:], xs[0])
    col = lambda m, part: F.col(f"{m}_{part}")
    potential = add([F.when(col(m, "value").isNotNull(), F.lit(w) * clamp(col(m, "value").cast("double"))).otherwise(F.lit(0.0)) for m, w in zip(metrics, weights, strict=True)])
    measured = add([col(m, "value").isNotNull().cast("int") for m in metrics])
    sample = add([F.least(F.lit(1.0), F.coalesce(col(m, "n"), F.lit(0)) / F.lit(20)) for m in metrics]) / k
    precision = add([F.when(col(m, "value").isNull(), 0.0).when(col(m, "low").isNull(), 0.5).otherwise(clamp(1 - (col(m, "high") - col(m, "low")).cast("double"))) for m in metrics]) / k
    proof = F.when(F.col("level") == "E2", 1.0).otherwise(0.0)
    confidence = 0.35 * measured / k + 0.25 * sample + 0.20 * precision + 0.20 * proof
    out = df.withColumns({"potential": half_up(potential), "actionability": F.coalesce(F.col("fit"), F.lit(0.0)), "coverage": half_up(measured / F.lit(float(k))), "confidence": half_up(confidence)})
    status = F.when(F.col("blocked").isNotNull(), F.col("blocked")).when(measured < k, "incomplete_metrics").when(F.col("confidence") < least_confidence, "low_confidence").otherwise("rankable")
    total = F.col("potential") * (0.8 + 0.2 * F.col("actionability")) * F.col("confidence")
    return out.withColumn("status", status).withColumn("total_score", F.when(F.col("status") == "rankable", half_up(total)))


def rank(df: DataFrame, id_col: str, total: str = "total_score", status: str = "status", bins: int = 1024) -> DataFrame:
    """Ranks of rankable rows by score and id, greatest first; the others keep no rank and their reason.

    A rank is the number of rows in better score bins and the place in its own, so no task sorts all rows.
    """
    ok = F.col(status) == "rankable"
    df = df.withColumn("_bin", F.when(ok, F.floor(F.col(total) * bins)))
    counts = df.where(ok).groupBy("_bin").agg(F.count(F.lit(1)).alias("_c"))
    starts = counts.select("_bin", (F.sum("_c").over(Window.orderBy(F.col("_bin").desc())) - F.col("_c")).alias("_start"))  # a row for each bin
    w = Window.partitionBy("_bin").orderBy(F.col(total).desc(), F.col(id_col).desc())
    out = df.join(starts, "_bin", "left").withColumn("rank", F.when(ok, F.col("_start") + F.row_number().over(w)).cast("long"))
    return out.withColumn("reason", F.when(~ok, F.col(status))).drop("_bin", "_start")


def backtest(predictions: DataFrame, base_rate: Column | float, keys: list[str] | None = None, least: int = 20) -> DataFrame:
    """Brier score of (p, y) against that of a constant; `insufficient_sample` under `least` rows."""
    base = base_rate if isinstance(base_rate, Column) else F.lit(float(base_rate))
    y = F.col("y").cast("double")
    aggs = [F.count(F.lit(1)).alias("evaluated"), F.sum("y").cast("long").alias("positives"), half_up(F.avg(F.pow(F.col("p") - y, F.lit(2)))).alias("brier"), half_up(F.avg(F.pow(base - y, F.lit(2)))).alias("baseline_brier")]
    out = predictions.groupBy(*(keys or [])).agg(*aggs)
    return out.withColumn("improvement", half_up(F.col("baseline_brier") - F.col("brier"))).withColumn("status", F.when(F.col("evaluated") < least, "insufficient_sample").otherwise("measured"))


def smoothed_rate(positives: Column, n: Column) -> Column:
    return (positives + 1) / (n + 2).cast("double")


def profile_fit(df: DataFrame, limits: dict[str, float], excluded: dict[str, list[str]]) -> DataFrame:
    """Coverage and fit of observed attributes to a profile.

    limits: attribute to its greatest value; excluded: attribute to values that block. An attribute that is
    null is unknown, which lowers coverage and leaves fit open under one half.
    """
    parts, codes = [F.lit(1)], []
    good = F.lit(1)
    for name, most in limits.items():
        parts.append(F.col(name).isNotNull().cast("int"))
        codes.append(F.when(F.col(name) > most, F.lit(f"{name}_above_limit")))
        good = good + F.coalesce((F.col(name) <= most).cast("int"), F.lit(0))
    for name, values in excluded.items():
        parts.append(F.col(name).isNotNull().cast("int"))
        codes.append(F.when(F.col(name).isin(values), F.lit(f"{name}_excluded")))
        good = good + F.coalesce((~F.col(name).isin(values)).cast("int"), F.lit(0))
    known = sum(parts[1:], parts[0])
    coverage = half_even(known / F.lit(float(len(parts))))
    b = F.array_compact(F.array(*codes))
    fit = F.when(F.size(b) > 0, F.lit(0.0)).when(coverage >= 0.5, half_even(ratio(good, known)))
    unknown = F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in [*limits, *excluded]]))
    return df.withColumns({"coverage": coverage, "fit": fit, "blockers": F.array_join(b, ","), "unknown": F.array_join(unknown, ",")})


# The components of a candidate and the type of claim that each needs.
COMPONENTS = {
    "customer": "customer_segment", "job": "job_to_be_done", "problem": "recurring_problem", "context": "problem_context", "current_alternative": "current_alternative",
    "solution_gap": "solution_gap", "payment_reason": "payment_reason", "entry_product": "entry_product_hypothesis", "distribution_path": "distribution_path", "expansion_path": "expansion_path_hypothesis",
}


def materialise_candidates(links: DataFrame, required: dict[str, str]) -> DataFrame:
    """Candidates whose component claims are complete, of the right type, supported, unrefuted and approved.

    links: candidate, component, claim_type, direction, is_current, approved, deterministic.
    """
    want = F.create_map(*[F.lit(x) for pair in required.items() for x in pair])
    per = links.groupBy("candidate", "component").agg(
        F.bool_and(F.try_element_at(want, F.col("component")) == F.col("claim_type")).alias("typed"), F.bool_and("is_current").alias("current"),
        F.bool_or(F.col("direction") == "supports").alias("supported"), F.bool_or(F.col("direction") == "refutes").alias("refuted"),
        F.bool_and(F.col("approved") | F.col("deterministic")).alias("approved"),
    )
    ok = F.coalesce(F.col("typed"), F.lit(False)) & F.col("current") & F.col("supported") & ~F.col("refuted") & F.col("approved")
    agg = per.groupBy("candidate").agg(F.count_if(ok).alias("n_valid"), F.count(F.lit(1)).alias("n_components"))
    return agg.withColumn("complete", (F.col("n_valid") == len(required)) & (F.col("n_components") == len(required)))
