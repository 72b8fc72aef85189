"""Relations between the clusters of two runs, and histories along them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions.exprs import half_even, ratio
from evidentia.operators import signals
from evidentia.session import materialise


NO_TOKEN = ""


def _pairs(previous: DataFrame, current: DataFrame, name: str) -> DataFrame:
    """Clusters of both runs that share an element, the number they share and their Jaccard index."""
    size = lambda df, key, n: df.groupBy(F.col("cluster").alias(key)).agg(F.count(F.lit(1)).alias(n))
    shared = previous.select(F.col("cluster").alias("previous"), "element").join(current.select(F.col("cluster").alias("current"), "element"), "element")
    both = shared.groupBy("previous", "current").agg(F.count(F.lit(1)).alias("s")).join(size(previous, "previous", "np"), "previous").join(size(current, "current", "nc"), "current")
    return both.select("previous", "current", half_even(F.col("s") / (F.col("np") + F.col("nc") - F.col("s"))).alias(name))


def _tokens(clusters: DataFrame, signatures: DataFrame) -> DataFrame:
    """(cluster, element) of the signatures; an empty one has a token of its own, as two empty ones are equal."""
    return clusters.join(signatures.select("cluster", F.col("token").alias("element")).distinct(), "cluster", "left").na.fill(NO_TOKEN, ["element"])


def relations(previous: DataFrame, current: DataFrame, previous_tokens: DataFrame, current_tokens: DataFrame, threshold: float = 0.6, stable: float = 0.8) -> DataFrame:
    """From (cluster, member) and (cluster, token) of two runs to (previous, current, member_jaccard, signature_jaccard, relation).

    Clusters are candidates if their members or their signatures are alike. They meet through the elements they
    share, not in all pairs; those without a partner follow as new or disappeared.
    """
    before, after = previous.select("cluster").distinct(), current.select("cluster").distinct()
    elements = lambda df: df.select("cluster", F.col("member").alias("element")).distinct()
    by_member = _pairs(elements(previous), elements(current), "member_jaccard")
    by_token = _pairs(_tokens(before, previous_tokens), _tokens(after, current_tokens), "signature_jaccard")
    both = by_member.join(by_token, ["previous", "current"], "full").na.fill(0.0, ["member_jaccard", "signature_jaccard"])
    both = both.where((F.col("member_jaccard") >= threshold) | (F.col("signature_jaccard") >= threshold))
    d_p = both.groupBy("previous").agg(F.count(F.lit(1)).alias("dp"))
    d_c = both.groupBy("current").agg(F.count(F.lit(1)).alias("dc"))
    kind = F.when(F.col("dp") > 1, "split").when(F.col("dc") > 1, "merged").when(F.col("member_jaccard") >= stable, "stable").otherwise("evolved")
    met = both.join(d_p, "previous").join(d_c, "current").select(F.col("previous").cast("string"), F.col("current").cast("string"), "member_jaccard", "signature_jaccard", kind.alias("relation"))
    no_text, no_value = F.lit(None).cast("string"), F.lit(None).cast("double")

    def alone(df: DataFrame, key: str, word: str) -> DataFrame:
        rest = df.select(F.col("cluster").alias(key)).join(both, key, "left_anti")
        return rest.select(*[F.col(key).cast("string") if k == key else no_text.alias(k) for k in ("previous", "current")], no_value.alias("member_jaccard"), no_value.alias("signature_jaccard"), F.lit(word).alias("relation"))

    return met.unionByName(alone(after, "current", "new")).unionByName(alone(before, "previous", "disappeared"))


def stability(related: DataFrame, least: int = 20, pass_rate: float = 0.8) -> DataFrame:
    """One row: counts by relation, the share of current clusters that are stable, their mean best overlap, and the gate's status.

    The mean takes each current cluster's best member overlap, 0 where it has no partner.
    """
    best = related.where("current is not null").groupBy("current").agg(F.coalesce(F.max("member_jaccard"), F.lit(0.0)).alias("best"))
    mean = best.agg(half_even(ratio(F.round(F.sum("best"), 6), F.count(F.lit(1)))).alias("mean_best_member_jaccard"))
    degree = lambda key: related.where("member_jaccard is not null").groupBy(key).agg(F.count(F.lit(1)).alias("d")).agg(F.coalesce(F.sum(F.when(F.col("d") > 1, F.col("d"))), F.lit(0)))
    n = related.agg(
        *[F.count_if(F.col("relation") == r).alias(r) for r in ("stable", "evolved", "split", "merged", "new", "disappeared")],
        F.count_distinct("previous").alias("previous_clusters"), F.count_distinct("current").alias("current_clusters"),
        F.count_distinct(F.when(F.col("member_jaccard").isNotNull(), F.col("current"))).alias("matched_clusters"),
    )
    one = lambda df, name: df.toDF(name)
    n = n.join(F.broadcast(mean)).join(F.broadcast(one(degree("previous"), "split_relations"))).join(F.broadcast(one(degree("current"), "merge_relations")))  # one row each
    n = n.withColumn("stability_rate", half_even(ratio(F.col("stable"), F.col("current_clusters"))))
    few = F.least("previous_clusters", "current_clusters") < least
    return n.withColumn("status", F.when(few, "insufficient_history").when(F.coalesce("stability_rate", F.lit(0.0)) < pass_rate, "below_stability_threshold").otherwise("passed"))


def _walks(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """node, ancestor, steps: walks of up to `depth` steps from each start node along (child, parent) edges, one parent a child.

    The length doubles each round: where a walk of some steps ends, the edges of twice that many go on. Rows of a
    round are written once; what is shuffled follows the result.
    """
    jump = materialise(edges)
    parts = [materialise(start.select("node").distinct().select("node", F.col("node").alias("ancestor"), F.lit(0).cast("long").alias("steps")))]
    span = 1
    while span <= depth:
        on = jump.select(F.col("child").alias("ancestor"), F.col("parent").alias("_next"))
        known = reduce(DataFrame.unionByName, parts).where(F.col("steps") + span <= depth)
        more = materialise(known.join(on, "ancestor").select("node", F.col("_next").alias("ancestor"), (F.col("steps") + span).alias("steps")))
        if more.isEmpty():
            break
        parts.append(more)
        span *= 2
        if span <= depth:
            jump = materialise(jump.select("child", F.col("parent").alias("ancestor")).join(on, "ancestor").select("child", F.col("_next").alias("parent")))
    return reduce(DataFrame.unionByName, parts)


def histories(spark: SparkSession, edges: DataFrame, start: DataFrame, depth: int = 50) -> DataFrame:
    """Walk back from each start node along (child, parent) edges: node, ancestor, steps. One parent per child.

    The walk ends after `depth` steps, which also ends a cycle. It has no limit on rows, as recursion in SQL has.
    """
    return _walks(edges.groupBy("child").agg(F.max("parent").alias("parent")), start, depth)


def chosen_edges(relations: DataFrame) -> DataFrame:
    """(child, parent): of the stable and evolved relations of a current cluster that of the run that finished last, then of the greatest id.

    relations: id, finished_at, previous, current, relation.
    """
    kept = relations.where(F.col("relation").isin("stable", "evolved") & F.col("previous").isNotNull() & F.col("current").isNotNull())
    return kept.groupBy(F.col("current").alias("child")).agg(F.max_by("previous", F.struct("finished_at", "id")).alias("parent"))


def stable_histories(relations: DataFrame, start: DataFrame, depth: int = 51) -> DataFrame:
    """node, ancestor, steps: each start node and the clusters it came from, one relation a step.

    A walk ends where no relation leads on, where it would meet itself again, or after `depth` steps. As each node has
    one parent, all that follows the first ancestor met twice has been met before: what counts is its least step.
    """
    return _walks(chosen_edges(relations), start, depth).groupBy("node", "ancestor").agg(F.min("steps").alias("steps"))


def history_points(histories: DataFrame, observations: DataFrame) -> DataFrame:
    """node, metric, as_of, value: the measured values of a cluster and all it came from, of each time the run that finished last.

    observations: cluster, metric, as_of, finished_at, run_id, status, value.
    """
    measured = observations.where((F.col("status") == "measured") & F.col("value").isNotNull())
    own = histories.select("node", F.col("ancestor").alias("cluster")).join(measured, "cluster")
    return own.groupBy("node", "metric", "as_of").agg(F.max_by("value", F.struct("finished_at", "run_id")).alias("value"))


def history_signals(points: DataFrame) -> DataFrame:
    """node, metric, points, first_at, last_at, and trend, anomaly and seasonality of the series."""
    keys = ["node", "metric"]
    points = materialise(points)  # every part reads them
    span = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("points"), F.min("as_of").alias("first_at"), F.max("as_of").alias("last_at"))
    parts = {
        "trend": signals.trend(points, keys, "as_of", "value").select(*keys, "slope", "relative_30d", "direction"),
        "anomaly": signals.anomaly(points, keys, "as_of", "value").select(*keys, F.col("status").alias("anomaly_status"), F.col("score").alias("anomaly_score")),
        "season": signals.seasonality(points, keys, "as_of", "value").select(*keys, F.col("status").alias("season_status"), "strength", "period_days"),
    }
    return reduce(lambda left, right: left.join(right, keys), parts.values(), span)
