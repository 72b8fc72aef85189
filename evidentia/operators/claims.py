"""Claims over a cluster's evidence: what may be proposed, and what may be approved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions.exprs import digest
from evidentia.operators.metrics import DIRECT_PAYMENT

# Types of claims, and the one that needs a direct payment.
CLAIM_TYPES = (
    "customer_segment", "job_to_be_done", "problem_context", "current_alternative", "solution_gap", "payment_reason",
    "entry_product_hypothesis", "distribution_path", "expansion_path_hypothesis",
)
PAYMENT_CLAIM = "payment_reason"
# Links that a task takes on average; the number of tasks follows the input, so that their memory does not.
ROWS = 500_000


def _commercial(links: DataFrame, claims: DataFrame, outcomes: DataFrame) -> DataFrame:
    """For each claim how many verified outcomes of its cluster it names, and whether one is a direct payment."""
    named = links.where("kind = 'commercial'").select("claim", F.col("target").alias("outcome")).distinct().join(claims.select("claim", "cluster"), "claim")
    pays = (F.col("outcome_type").isin(*DIRECT_PAYMENT)) & (F.col("outcome_direction") == "supports")
    known = named.join(outcomes.select("cluster", "outcome", "outcome_type", F.col("direction").alias("outcome_direction")), ["cluster", "outcome"])
    return known.groupBy("claim").agg(F.count(F.lit(1)).alias("n_commercial"), F.bool_or(pays).alias("paid"))


def proposals(claims: DataFrame, links: DataFrame, members: DataFrame, outcomes: DataFrame, types=CLAIM_TYPES) -> DataFrame:
    """claim, action, n_support, fingerprint: whether each claim may go to review, or the first thing that speaks against it.

    claims: claim, cluster, claim_type, statement; links: claim, kind (evidence or commercial), target,
    direction; members: cluster, evidence; outcomes: cluster, outcome, outcome_type, direction, verified ones only.
    """
    n = links.count() // ROWS + 1
    links, claims = links.repartition(n, "claim"), claims.repartition(n, "claim")
    e = links.where("kind = 'evidence'").groupBy("claim", F.col("target").alias("evidence")).agg(F.bool_or(F.col("direction") == "supports").alias("s"), F.bool_or(F.col("direction") == "refutes").alias("r"))
    inside = members.select("cluster", "evidence").repartition(n, "cluster", "evidence").distinct().withColumn("inside", F.lit(True))
    placed = e.join(claims.select("claim", "cluster"), "claim").repartition(n, "cluster", "evidence").join(inside, ["cluster", "evidence"], "left")
    per = placed.repartition(n, "claim").groupBy("claim").agg(
        F.bool_or(F.col("s") & F.col("r")).alias("both"), F.bool_or(F.col("inside").isNull()).alias("outside"), F.count_if("s").alias("n_support"),
        # order does not matter to a sum, so a claim with many links is not gathered
        F.sum(F.xxhash64("evidence", "s", "r").cast("decimal(38,0)")).alias("mark"),
    )
    j = claims.join(per, "claim", "left").join(_commercial(links, claims, outcomes), "claim", "left").na.fill(0, ["n_support", "n_commercial"])
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    action = (
        F.when(~F.col("claim_type").isin(*types), "unsupported_claim_type").when(F.coalesce(F.trim("statement"), F.lit("")) == "", "missing_statement")
        .when(yes("both"), "evidence_on_both_sides").when(yes("outside"), "evidence_outside_cluster").when((F.col("n_support") == 0) & (F.col("n_commercial") == 0), "no_evidence")
        .when((F.col("claim_type") == PAYMENT_CLAIM) & ~yes("paid"), "payment_not_direct").otherwise("pending_review")
    )
    return j.select("claim", action.alias("action"), "n_support", "n_commercial", digest(F.col("cluster"), F.col("claim_type"), F.col("statement"), F.col("mark")).alias("fingerprint"))


def approvals(claims: DataFrame, links: DataFrame, outcomes: DataFrame, reviews: DataFrame) -> DataFrame:
    """claim, action: what a review does; reviews: claim, reviewer, decision; claims also has created_by and status."""
    d = links.groupBy("claim").agg(F.bool_or(F.col("direction") == "supports").alias("supported"), F.bool_or(F.col("direction") == "refutes").alias("refuted"))
    j = reviews.join(claims, "claim").join(d, "claim", "left").join(_commercial(links, claims, outcomes), "claim", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    approve = F.col("decision") == "approved"
    action = (
        F.when(F.col("reviewer") == F.col("created_by"), "reviewer_is_creator").when(~F.col("decision").isin("approved", "rejected"), "unsupported_decision").when(F.col("status") != "pending_review", "not_pending")
        .when(approve & ~yes("supported"), "no_support").when(approve & yes("refuted"), "counter_evidence").when(approve & (F.col("claim_type") == PAYMENT_CLAIM) & ~yes("paid"), "payment_not_direct").otherwise(F.col("decision"))
    )
    return j.select("claim", action.alias("action"))
