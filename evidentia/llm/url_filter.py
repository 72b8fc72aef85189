"""URL filtering by rules and by a tree of path templates.

Rules decide first, and what they decide labels the tree. For each host, paths are cut into segments, and a
segment that varies (it holds a digit, or is long) becomes a wildcard. Then, level by level, among the
constant branches below a node:

- where they are many and hardly repeat, all become a wildcard;
- else those that are statistically like the rest of the node merge into one branch, "~". Alike means that
  the shapes of what lies below (constant or wildcard, segment by segment) do not differ from those of the
  others by a chi-square test, and that the blocked shares do not differ by a two-proportion test, which
  asks for `least_labelled` labelled pages on either side. So a branch without labels joins labelled ones of
  its form where those agree among themselves, and none where they disagree.

A template is rejected if it has `least_labelled` labelled pages and the purity of those, the share that is
blocked, smoothed towards its host's and that towards the share over all hosts, is `purity` or more.

The tree is a table of counts by (host, template), summed before every shuffle; no host is gathered. Branches
merge on the first `depth` levels; deeper segments stay as they are and keep templates apart.

Defined results: a null url, or one without "://", has an empty host and path, no rule and no template, and
is allowed; a path of any length counts whole; what ties at a limit passes it (equal purity rejects, an equal
test value merges); repeated rows count and stay repeated; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import materialise

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
DEPTH = 4
FANOUT = 32
REPEATS = 4
LONG = 24
Z = 2.58
LEAST_LABELLED = 5
PURITY = 0.9
SMOOTHING = 2.0
WILD, MERGED = "*", "~"
COUNTS = ("pages", "blocked", "allowed")


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Struct of the longest rule that fits and its verdict, or null."""

    def fits(rule: str) -> Column:
        name, _, rest = rule.partition("/")
        return ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)

    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        found = F.when(fits(rule), F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _segments(path: Column) -> Column:
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(parts, lambda s: F.when(s.rlike("[0-9]") | (F.length(s) > LONG), F.lit(WILD)).otherwise(s))


def _shape(rest: Column) -> Column:
    return F.array_join(F.transform(rest, lambda s: F.when(s == WILD, F.lit(WILD)).otherwise(F.lit("c"))), "/")


def _sums(prefix: str = "") -> list[Column]:
    return [F.sum(c).alias(prefix + c) for c in COUNTS]


def _critical(df: Column) -> Column:
    """Chi-square value that is exceeded by chance in one of a hundred cases (Wilson and Hilferty)."""
    spread = 2 / (9 * df)
    return df * F.pow(1 - spread + 2.326348 * F.sqrt(spread), 3)


def turned_branches(tree: DataFrame, level: int) -> DataFrame:
    """(host, above, branch, to) of the constant branches of this level that become a wildcard or merge."""
    here, above, below = F.get(F.col("path"), F.lit(level - 1)), F.slice("path", 1, level - 1), F.slice("path", F.lit(level + 1), F.size("path"))
    cells = tree.where(F.size("path") >= level).select("host", above.alias("above"), here.alias("branch"), _shape(below).alias("shape"), *COUNTS)
    cells = materialise(cells.where(F.col("branch") != WILD).groupBy("host", "above", "branch", "shape").agg(*_sums()))
    node = cells.groupBy("host", "above").agg(F.count_distinct("branch").alias("fan"), F.count_distinct("shape").alias("shapes"), *_sums("all_")).where("fan > 1")
    shapes = cells.groupBy("host", "above", "shape").agg(F.sum("pages").alias("of_shape"))
    part = F.col("pages") * F.col("pages") / F.col("of_shape")
    branch = cells.join(materialise(shapes), ["host", "above", "shape"]).groupBy("host", "above", "branch").agg(*_sums(), F.sum(part).alias("parts"))
    both = branch.join(materialise(node), ["host", "above"])
    rest = F.col("all_pages") - F.col("pages")
    chi = F.round(F.col("all_pages") / F.col("pages") * F.col("all_pages") / rest * (F.col("parts") - F.col("pages") * F.col("pages") / F.col("all_pages")), 6)
    like_form = (F.col("shapes") == 1) | (chi <= _critical(F.greatest(F.col("shapes") - 1, F.lit(1))))
    seen = F.col("blocked") + F.col("allowed")
    others = F.col("all_blocked") + F.col("all_allowed") - seen
    share = F.try_divide(F.col("all_blocked"), seen + others)
    spread = F.sqrt(share * (1 - share) * (1 / F.greatest(seen, F.lit(1)) + 1 / F.greatest(others, F.lit(1))))
    gap = F.abs(F.try_divide(F.col("blocked"), seen) - F.try_divide(F.col("all_blocked") - F.col("blocked"), others))
    # a branch of few labels joins only where the labelled ones agree
    mixed = (F.col("all_blocked") >= LEAST_LABELLED) & (F.col("all_allowed") >= LEAST_LABELLED)
    like_labels = F.when((seen >= LEAST_LABELLED) & (others >= LEAST_LABELLED), F.round(gap - Z * spread, 9) <= 0).otherwise((seen >= LEAST_LABELLED) | ~mixed)
    scattered = (F.col("fan") > FANOUT) & (F.col("all_pages") < REPEATS * F.col("fan"))
    to = F.when(scattered, F.lit(WILD)).when(like_form & F.coalesce(like_labels, F.lit(True)), F.lit(MERGED))
    turned = materialise(both.select("host", "above", "branch", to.alias("to")).where("to is not null"))
    alone = turned.groupBy("host", "above").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("host", "above")
    return materialise(turned.join(alone, ["host", "above"], "left_anti"))


def templates(counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """From (host, segments, pages, blocked, allowed) to the same with the template, `path`, of each."""
    tree = counts.withColumn("path", F.col("segments"))
    for level in range(1, depth + 1):
        if tree.where(F.size("path") >= level).isEmpty():
            break
        above, branch = F.slice("path", 1, level - 1), F.get(F.col("path"), F.lit(level - 1))
        level_tree = tree.withColumns({"above": above, "branch": branch}).join(turned_branches(tree, level), ["host", "above", "branch"], "left")
        joined = F.concat("above", F.array("to"), F.slice("path", F.lit(level + 1), F.size("path")))
        tree = level_tree.withColumn("path", F.when(F.col("to").isNull(), F.col("path")).otherwise(joined)).select("host", "segments", "path", *COUNTS)
        tree = materialise(tree)
    return tree


def purity_of(blocked: Column, labelled: Column, prior: Column) -> Column:
    return (blocked + SMOOTHING * prior) / (labelled + SMOOTHING)


def judged_templates(tree: DataFrame, purity: float) -> DataFrame:
    """(host, template, pure, rejected)."""
    labelled = F.col("blocked") + F.col("allowed")
    known = tree.agg(*_sums()).first()  # one row of counts
    blocked, allowed = known.blocked or 0, known.allowed or 0
    overall = purity_of(F.lit(float(blocked)), F.lit(float(blocked + allowed)), F.lit(0.5))
    hosts = tree.groupBy("host").agg(*_sums()).select("host", purity_of(F.col("blocked"), labelled, overall).alias("prior"))
    sums = tree.groupBy("host", F.col("path").alias("template")).agg(*_sums()).join(materialise(hosts), "host")
    pure = F.round(purity_of(F.col("blocked"), labelled, F.col("prior")), 9)
    return materialise(sums.select("host", "template", pure.alias("pure"), ((labelled >= LEAST_LABELLED) & (pure >= purity)).alias("rejected")))


def judge(pages: DataFrame, rules=RULES, depth: int = DEPTH, purity: float = PURITY) -> DataFrame:
    """page_id, host, path, rule, verdict, template, template_purity."""
    base = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    base = base.withColumn("ruled", rule_of(F.col("host"), F.col("path"), rules)).withColumn("segments", _segments(F.col("path")))
    marks = [F.count_if(F.col("ruled.verdict") == v).alias(c) for v, c in (("block", "blocked"), ("allow", "allowed"))]
    counts = materialise(base.where("host <> ''").groupBy("host", "segments").agg(F.count(F.lit(1)).alias("pages"), *marks))
    tree = templates(counts, depth)
    found = tree.select("host", "segments", F.col("path").alias("template")).join(judged_templates(tree, purity), ["host", "template"])
    judged = base.join(materialise(found), ["host", "segments"], "left")
    own = F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(
        "page_id",
        "host",
        "path",
        F.col("ruled.rule").alias("rule"),
        F.coalesce(F.col("ruled.verdict"), own).alias("verdict"),
        F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"),
        F.round("pure", 6).alias("template_purity"),
    )
