"""Evidence spans, exact set-similarity joins and star clusters."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.exprs import digest, half_even, token_similarity
from evidentia.functions.text import EVIDENCE_RULES, excerpt, is_problem, spans
from evidentia.operators import prefixes
from evidentia.session import checkpoint, materialise

MICRO = 1_000_000


def _cells(field: str, key: str, kind: str, confidence: float, pattern: str) -> Column:
    text = F.coalesce(F.col(field), F.lit(""))

    def cell(s: Column) -> Column:
        return F.struct(
            F.lit(key).alias("rule"), F.lit(kind).alias("evidence_type"), F.lit(confidence).alias("confidence"), F.lit(field).alias("field"),
            s["start"].alias("start"), s["end"].alias("end"), s["matched"].alias("matched"), excerpt(text, s["start"], s["end"]).alias("excerpt"),
        )

    return F.transform(spans(text, pattern), cell)


def evidence(docs: DataFrame, id_col: str = "doc_id", fields=("title", "body"), rules=EVIDENCE_RULES, problems: bool = True) -> DataFrame:
    """A row for every match of every rule in every field, and one for the title of a problem report.

    Documents without an entity or a title and those of bots have none, where docs has the columns entity_id,
    title and is_bot.
    """
    for name, keep in (("entity_id", F.col("entity_id").isNotNull()), ("title", F.coalesce(F.col("title"), F.lit("")) != ""), ("is_bot", ~F.coalesce(F.col("is_bot"), F.lit(False)))):
        docs = docs.where(keep) if name in docs.columns else docs
    cells = [_cells(field, *rule) for field in fields for rule in rules]
    if problems:
        whole = F.struct(
            F.lit("problem_report").alias("rule"), F.lit("problem_report").alias("evidence_type"), F.lit(0.7).alias("confidence"), F.lit("title").alias("field"),
            F.lit(0).alias("start"), F.length("title").alias("end"), F.col("title").alias("matched"), F.left(F.col("title"), F.lit(500)).alias("excerpt"),
        )
        labels = F.col("labels") if "labels" in docs.columns else F.array().cast("array<string>")
        cells.append(F.when(is_problem(F.col("title"), labels), F.array(whole)).otherwise(F.array().cast("array<struct<rule:string,evidence_type:string,confidence:double,field:string,start:int,end:int,matched:string,excerpt:string>>")))
    out = docs.select(F.col(id_col), F.explode(F.flatten(F.array(*cells))).alias("e")).select(id_col, "e.*")
    return out.withColumn("evidence_hash", digest(F.col(id_col), F.col("rule"), F.col("field"), F.col("start"), F.col("end"), F.col("excerpt")))


def similar_pairs(items: DataFrame, id_col: str, set_col: str, threshold: float = 0.6, least_shared: int = 2) -> DataFrame:
    """(a, b, shared, similarity) of all pairs whose sets are similar: an exact join by prefix, length, place and code.

    Equal sets are one class that is joined once; its copies come in at the end, in joins of ids alone whose rows are
    the result, so that no set is dealt out for a pair of copies. Of different sets only those that are in a candidate
    pair are dealt out.
    """
    each = items.select(F.col(id_col).alias("item"), F.array_sort(F.array_distinct(set_col)).alias("s")).where(F.size("s") > 0)
    each = materialise(each.select("item", F.unhex(F.sha2(F.to_json("s"), 256)).alias("digest"), "s"))
    sets = each.groupBy("digest").agg(F.first("s").alias("s")).select(F.monotonically_increasing_id().alias("id"), "digest", F.size("s").alias("n"), "s")
    sets = materialise(sets)
    members = materialise(each.select("item", "digest").join(sets.select("digest", "id", F.col("n").cast("long").alias("n")), "digest").select("item", "id", "n"))
    pairs = materialise(candidates(sets, threshold))
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    texts = materialise(sets.select("id", "s").join(ends, "id", "left_semi"))
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(texts.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    out = both.select("a", "b", shared.cast("long").alias("shared"), token_similarity(F.col("sa"), F.col("sb")).alias("similarity"))
    alike = materialise(out.where((F.col("shared") >= least_shared) & (F.col("similarity") >= threshold)).select("a", "b", "shared", "similarity"))
    left, right = members.select(F.col("id").alias("a"), F.col("item").alias("i")), members.select(F.col("id").alias("b"), F.col("item").alias("j"))
    apart = alike.join(left, "a").join(right, "b").where("i <> j").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "shared", "similarity")
    copies = members.join(right, F.col("id") == F.col("b")).where("item < j").select(F.col("item").alias("a"), F.col("j").alias("b"), F.col("n").alias("shared"), F.lit(1.0).alias("similarity"))
    return apart.unionByName(copies)


def candidates(sets: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs (a, b) of the different sets (id, s) that can reach the threshold, all of those and hardly any other.

    Sets are taken in order of how rare their tokens are; a pair in reach of the threshold shares a token among the
    first of both, so only those meet. Whether two sets that meet can reach it is decided in the join by their sizes,
    by what stands behind the shared token and by parity codes: every bit in which these differ takes a token that
    only one set has. So the pairs that leave the join follow the similar ones and not those that share a token.
    """
    low = threshold - 1e-6  # similarities are rounded to six digits
    hashed = sets.select("id", F.transform("s", lambda t: F.xxhash64(t)).alias("h"))
    counts = hashed.select(F.explode("h").alias("x")).groupBy(F.col("x").bitwiseAND(F.lit(prefixes.CELLS - 1)).alias("cell")).agg(F.count(F.lit(1)).alias("c")).toArrow()  # no more rows than cells
    met = np.zeros(prefixes.CELLS, dtype=np.int64)
    met[counts.column("cell").to_numpy()] = counts.column("c").to_numpy()
    keyed = hashed.mapInArrow(prefixes.postings(low, met), prefixes.POSTING)
    x, y = keyed.alias("x"), keyed.alias("y")
    both = F.col("x.n") + F.col("y.n")
    shorter = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.id") < F.col("y.id")))
    # what stands behind the shared token on either side has to suffice for the overlap that the threshold asks
    behind = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos")) * (1 + low) + 1e-9 >= both * low
    differ = reduce(lambda p, q: p + q, (F.bit_count(F.col(f"x.c{i}").bitwiseXOR(F.col(f"y.c{i}"))) for i in range(prefixes.CODE_WORDS)))
    meet = (
        (F.col("x.key") == F.col("y.key"))
        & (F.col("x.id") < F.col("y.id"))
        & F.when(shorter, F.col("x.short")).otherwise(F.col("y.short"))
        & (F.least("x.n", "y.n") >= threshold * F.greatest("x.n", "y.n"))
        & behind
        & (differ * (1 + low) <= both * (1 - low) + 1e-9)
    )
    return x.join(y, meet).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def star_clusters(items: DataFrame, id_col: str, set_col: str, hash_col: str, slice_col: str, threshold: float = 0.6) -> DataFrame:
    """Greedy cover of each slice by stars: slice, id, representative, similarity to it.

    The next representative is the item with most neighbours left, then the greatest sum of similarity to what
    is left, then the greatest hash; its neighbours leave with it. That order is kept without going one by one:
    a star only changes the ranks of items within two steps of its centre in the graph of all similar pairs, so
    in every round each item that outranks all within two steps becomes a star. Items without a neighbour rank
    below all others and are stars of their own in the end. Pairs come from the tokens they share, so the work
    follows the pairs of a slice with two tokens in common; no slice is gathered.
    """
    rows = items.select(F.col(slice_col).cast("string").alias("slice"), F.col(id_col).cast("string").alias("id"), F.array_distinct(set_col).alias("s"), F.col(hash_col).alias("h"))
    rows = rows.where(F.size("s") >= 3).dropDuplicates(["slice", "id"])
    tokens = rows.select("slice", "id", F.size("s").alias("n"), F.explode("s").alias("token"))
    x, y = tokens.select("slice", "token", F.col("id").alias("a"), F.col("n").alias("na")), tokens.select("slice", "token", F.col("id").alias("b"), F.col("n").alias("nb"))
    shared = x.join(y, ["slice", "token"]).where("a <> b").groupBy("slice", "a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("c")).where("c >= 2")
    similarity = F.round(half_even(F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))) * MICRO).cast("long")
    edges = checkpoint(shared.select("slice", "a", "b", similarity.alias("m")))
    left, stars = checkpoint(rows.select("slice", "id", "h")), []
    near = round(threshold * MICRO)
    while True:
        rank = edges.groupBy("slice", "a").agg(F.count_if(F.col("m") >= near).alias("n"), F.sum("m").alias("total")).where("n > 0")
        rank = checkpoint(rank.join(left.withColumnRenamed("id", "a"), ["slice", "a"]).select("slice", "a", F.struct("n", "total", "h", "a").alias("rank")))
        if rank.isEmpty():
            break
        # the greatest rank within one step, and of those within one more
        over = lambda r: edges.join(r, ["slice", "a"]).select("slice", F.col("b").alias("a"), "rank").unionByName(r).groupBy("slice", "a").agg(F.max("rank").alias("rank"))
        most = over(checkpoint(over(rank))).withColumnRenamed("rank", "most")
        chosen = checkpoint(rank.join(most, ["slice", "a"]).where("rank = most").select("slice", "a"))
        around = edges.where(F.col("m") >= near).join(chosen, ["slice", "a"]).select("slice", F.col("b").alias("id"), F.col("a").alias("representative"), (F.col("m") / MICRO).alias("similarity"))
        star = checkpoint(chosen.select("slice", F.col("a").alias("id"), F.col("a").alias("representative"), F.lit(1.0).alias("similarity")).unionByName(around))
        stars.append(star)
        gone = star.select("slice", "id")
        left = checkpoint(left.join(gone, ["slice", "id"], "left_anti"))
        edges = checkpoint(edges.join(gone.withColumnRenamed("id", "a"), ["slice", "a"], "left_anti").join(gone.withColumnRenamed("id", "b"), ["slice", "b"], "left_anti").select("slice", "a", "b", "m"))
    alone = left.select("slice", "id", F.col("id").alias("representative"), F.lit(1.0).alias("similarity"))
    return reduce(DataFrame.unionByName, stars, alone)


def describe_clusters(members: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each star: label, signature, fingerprint, sizes, cohesion, first and last date, status.

    members: slice, id, representative, similarity; items: id, text, s (tokens), h (hash), entity, document, at.
    """
    m = members.join(items.withColumn("id", F.col("id").cast("string")), "id").withColumn("cluster", F.col("representative"))
    n = m.groupBy("slice", "cluster").agg(
        F.count(F.lit(1)).alias("members"), F.count_distinct("entity").alias("entities"), F.count_distinct("document").alias("documents"),
        F.min("similarity").alias("cohesion_min"), half_even(F.sum("similarity") / F.count(F.lit(1))).alias("cohesion_mean"), F.min("at").alias("first_at"), F.max("at").alias("last_at"),
        F.max(F.when(F.col("id") == F.col("representative"), F.left("text", F.lit(500)))).alias("label"), F.sha2(F.array_join(F.sort_array(F.collect_list("h")), "|"), 256).alias("fingerprint"),
    )
    # a representative may stand in several slices
    both = F.struct("slice", "cluster")
    signed = signatures(m.select(both.alias("key"), "s"), "key", "s").select("key.slice", "key.cluster", "signature")
    return n.join(signed, ["slice", "cluster"]).withColumn("status", cluster_status(F.col("members"), F.col("entities")))


def signatures(members: DataFrame, cluster: str, set_col: str) -> DataFrame:
    """Tokens that all members of a cluster share, sorted, and the members' count."""
    n = members.groupBy(cluster).agg(F.count(F.lit(1)).alias("members"))
    each = members.select(cluster, F.explode(F.array_distinct(set_col)).alias("token")).groupBy(cluster, "token").agg(F.count(F.lit(1)).alias("c"))
    common = each.join(n, cluster).where("c = members").groupBy(cluster).agg(F.array_join(F.sort_array(F.collect_list("token")), ",").alias("signature"))
    return n.join(common, cluster, "left").select(cluster, "members", F.coalesce("signature", F.lit("")).alias("signature"))


def cluster_status(members: Column, entities: Column) -> Column:
    return F.when(members <= 1, "insufficient_repetition").when(entities <= 1, "within_entity_repeated").otherwise("cross_entity_candidate")
