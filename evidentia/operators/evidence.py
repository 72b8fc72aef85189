"""Independence of sources, quality audits, claims."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions.exprs import half_even, ratio, wilson


def independence(origins: DataFrame, sources: DataFrame, relationships: DataFrame) -> DataFrame:
    """Level and sorted blockers for each cluster.

    origins: cluster, source, entity, content; sources: source, grp, status; relationships: low, high (sorted
    pair), type, effect, scope (global, same_entity or same_content).
    """
    pairs = origins.select("cluster", "source").distinct()
    known = pairs.join(sources, "source", "left")
    base = known.groupBy("cluster").agg(
        F.count_distinct("source").alias("n_sources"), F.count_distinct("grp").alias("n_groups"), F.count_if(F.col("grp").isNull()).alias("n_unknown"),
        F.collect_set(F.when(F.col("status") != "independent", F.concat_ws(":", F.lit("source_status"), "source", "status"))).alias("by_status"),
    )
    rel = relationships.where(F.col("effect") != "none")
    # two equi-joins on the source, so that clusters are never paired with all relationships
    found = []
    for scope, keys in (("global", ["cluster"]), ("same_entity", ["cluster", "entity"]), ("same_content", ["cluster", "content"])):
        side = origins.select(*keys, "source").distinct()
        low = side.join(rel.where(F.col("scope") == scope), F.col("source") == F.col("low")).drop("source")
        found.append(low.join(side.withColumnRenamed("source", "high"), [*keys, "high"]).select("cluster", F.concat_ws(":", F.lit("relationship"), "type", "effect").alias("blocker")))
    related = found[0].union(found[1]).union(found[2]).groupBy("cluster").agg(F.collect_set("blocker").alias("by_relation"))
    j = base.join(related, "cluster", "left")
    empty = F.array().cast("array<string>")
    shared = F.when(F.col("n_groups") < 2, F.array(F.lit("shared_independence_group"))).otherwise(empty)
    many = F.array_sort(F.concat(shared, "by_status", F.coalesce("by_relation", empty)))
    blockers = F.when(F.col("n_unknown") > 0, F.array(F.lit("source_registry_incomplete"))).when(F.col("n_sources") == 1, F.array(F.lit("single_source"))).otherwise(many)
    level = F.when(F.col("n_unknown") > 0, "unknown").when(F.col("n_sources") == 1, "E1").when(F.size(many) == 0, "E2").otherwise("unverified_cross_source")
    return j.select("cluster", "n_sources", level.alias("level"), F.array_join(blockers, ",").alias("blockers"))


def quality_gate(audits: DataFrame, eligible: DataFrame, least_audits: int = 20, least_coverage: float = 0.2, least_purity: float = 0.8) -> DataFrame:
    """One row: coverage and purity of the latest audit of each eligible cluster, with an interval, and the status.

    audits: cluster, at, audit_id, sampled, coherent; eligible: cluster.
    """
    latest = audits.groupBy("cluster").agg(F.max_by(F.struct("sampled", "coherent"), F.struct("at", "audit_id")).alias("a"))
    j = eligible.select("cluster").distinct().join(latest, "cluster", "left")
    n = j.agg(
        F.count(F.lit(1)).alias("eligible"), F.count("a").alias("audited"), F.coalesce(F.sum("a.sampled"), F.lit(0)).alias("sampled"),
        F.coalesce(F.sum("a.coherent"), F.lit(0)).alias("coherent"), F.count_if(F.col("a.coherent") >= least_purity * F.col("a.sampled")).alias("coherent_clusters"),
    )
    low, high = wilson(F.col("coherent"), F.col("sampled"))
    n = n.withColumns(
        {"coverage": half_even(ratio(F.col("audited"), F.col("eligible"))), "purity": half_even(ratio(F.col("coherent"), F.col("sampled"))),
         "purity_low": low, "purity_high": high, "coherence": half_even(ratio(F.col("coherent_clusters"), F.col("audited")))}
    )
    status = (
        F.when(F.col("eligible") == 0, "insufficient_clusters").when((F.col("audited") < least_audits) | (F.col("coverage") < least_coverage), "insufficient_audits")
        .when((F.col("purity") < least_purity) | (F.col("coherence") < least_purity), "below_quality_threshold").otherwise("passed")
    )
    return n.withColumn("status", status)


def claims(current: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Action for each claim by its fingerprint: created, reused, or superseding the stored one.

    current and fingerprints: claim, fingerprint.
    """
    j = current.alias("c").join(fingerprints.alias("f"), "claim", "left")
    action = F.when(F.col("f.fingerprint").isNull(), "created").when(F.col("f.fingerprint") == F.col("c.fingerprint"), "reused").otherwise("superseded")
    return j.select("claim", F.col("c.fingerprint").alias("fingerprint"), action.alias("action"), F.when(action == "superseded", F.col("f.fingerprint")).alias("supersedes"))
