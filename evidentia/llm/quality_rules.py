"""Quality rules: fixed limits and robust multivariate outliers, in DataFrame functions alone.

Fixed limits come first: too few words, or too many of them inside repeated eight-word windows. The texts
that pass are judged against those of their own language and source. Four statistics, logarithms of mean
word length and of the shares of symbols, repeated lines and repeated words, make a vector; centre and
covariance are those of minimum determinant over three quarters of the group. Three starts (the rows nearest
to the group's medians by their worst, by their summed and by their squared deviations) each go through
concentration steps: mean and covariance of the subset, then the three quarters of least Mahalanobis
distance. A step that does not lower a start's determinant is not taken; when none lowers any, the start of
least determinant counts. A text is rejected if its squared distance, scaled so that the group's median fits
a chi-square of four degrees, is above the 0.999 quantile of that distribution.

A group of fewer than `least_rows` rows is judged against all texts of its language, and where those are
too few against all texts, so that every text that passes the limits is judged.

Statistics are whole numbers of a thousandth, so that their sums do not depend on the order of addition;
quantiles come from counts by narrow bins, one bin being a thirty-second of a power of e. Both are summed
before they are shuffled, and the rows meet what was found of their group by a join that Spark broadcasts
where the table of groups is small, so a group that holds a third of all rows is as cheap as any. A floor
on each variance keeps a statistic that is zero nearly everywhere from rejecting the first text where it is
not: a third of the step from none to the least that a short text can show, which is one symbol in fifty
characters, one line in twenty, eight words in a hundred; for the word length, the scatter of a mean of
twenty words.

Defined results: a null text has no words and fails the fixed limits, as an empty one does; a null language
or source makes a group like any value; of rows that share a bin all or none are in a subset, so ties do
not depend on order; very long texts count whole; repeated rows stay repeated; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.common import materialise

GAPS = r"[\x20\x09-\x0D]+"
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
SPAN = 8
LEAST_WORDS = 20
MOST_REPEATED = 30
DIMS = ("v1", "v2", "v3", "v4")
FLOORS = (0.12, math.log(3) / 3, math.log(6) / 3, math.log(9) / 3)
UNIT = 1_000
SHARE = 0.75
STARTS = 3
CUT = 18.467  # chi-square of four degrees, 0.999
HALF_CHI2 = 3.3567  # and its median
LEAST_ROWS = 20
LEAST_GAIN = 1e-3


def base_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    df = docs.select("doc_id", "lang", "source", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    df = df.withColumn("w", F.array_remove(F.split("t", GAPS), "")).withColumn("n", F.size("w"))
    df = df.withColumn("lines", F.filter(F.split("t", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
    df = df.select(
        "doc_id",
        "lang",
        "source",
        F.col("n").cast("long").alias("n_words"),
        F.length(F.translate("t", WHITE, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("n") > SPAN, F.transform("w", lambda x: F.xxhash64(x))).alias("h"),
    )
    size, room = 1, F.col("n_words").cast("int")
    while size < SPAN:
        left = F.slice("h", F.lit(1), room - (2 * size - 1))
        df = df.withColumn("h", F.when(F.col("h").isNotNull(), F.zip_with(left, F.slice("h", F.lit(size + 1), room - (2 * size - 1)), lambda a, b: F.xxhash64(a, b))))
        size *= 2
    twice = F.size(F.array_distinct("h")) < F.size("h")
    df = df.withColumn("s", F.when(twice, F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))).drop("h")
    same = lambda x, j: F.coalesce(F.get(F.col("s"), j)["x"] == x["x"], F.lit(False))
    df = df.withColumn("p", F.transform(F.filter("s", lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"])).withColumn("p", F.array_sort("p")).drop("s")
    gaps = F.transform("p", lambda x, j: F.least(F.lit(SPAN), F.coalesce(F.get(F.col("p"), j + 1) - x, F.lit(SPAN))))
    covered = F.aggregate(gaps, F.lit(0), lambda a, g: a + g)
    return df.select(*[c for c in df.columns if c != "p"], F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _vector() -> list[Column]:
    logs = (
        F.ln(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))),
        F.log1p(100 * F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        F.log1p(100 * F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        F.log1p(100 * F.col("n_repeat_words") / F.greatest(F.col("n_words"), F.lit(1))),
    )
    return [F.round(x * UNIT).cast("long").alias(d) for x, d in zip(logs, DIMS, strict=True)]


def _quantiles(binned: DataFrame, dims: list[str], share: float) -> DataFrame:
    """For each group and each of the bin columns the least bin that, with those below it, holds the share of the group's rows."""
    tall = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("long").alias("bin")) for d in dims])).alias("x")
    counts = binned.select("group", tall).groupBy("group", "x.dim", "x.bin").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("group", "dim")
    run = counts.withColumn("upto", F.sum("c").over(w.orderBy("bin"))).withColumn("rows", F.sum("c").over(w))
    found = run.where(F.col("upto") >= share * F.col("rows")).groupBy("group", "dim").agg(F.min("bin").alias("bin"))
    return found.groupBy("group").agg(*[F.max(F.when(F.col("dim") == d, F.col("bin"))).alias(d) for d in dims])


def _small(df: DataFrame) -> DataFrame:
    """A table by group in few files, so that Spark sees how small it is and broadcasts it if it is."""
    return materialise(df.repartition(8))


def _medians(rows: DataFrame, names: list[str]) -> DataFrame:
    """Group, and the median of each statistic to a hundredth."""
    mid = _quantiles(rows.select("group", *[F.floor(F.col(d) / 10).alias(n) for d, n in zip(DIMS, names, strict=True)]), names, 0.5)
    return _small(mid.select("group", *[(F.col(n) * 10 + 5).alias(n) for n in names]))


def _log_bin(x: Column) -> Column:
    return F.floor(F.ln(x + 1e-6) * 32)


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(DIMS)) for j in range(i + 1)]


def _moments(rows: DataFrame, inside: dict[int, Column]) -> DataFrame:
    """Group and, for each start, mean (mu), lower Cholesky factor (l) of the covariance with the floors added, and its determinant."""
    sums = []
    for n, chosen in inside.items():
        sums += [F.count_if(chosen).alias(f"k{n}"), *[F.sum(F.when(chosen, F.col(d))).alias(f"s{n}{i}") for i, d in enumerate(DIMS)]]
        sums += [F.sum(F.when(chosen, F.col(DIMS[i]) * F.col(DIMS[j]))).alias(f"q{n}{i}{j}") for i, j in _pairs()]
    m = rows.groupBy("group").agg(*sums)
    for n in inside:
        m = m.withColumns({f"mu{n}{i}": F.col(f"s{n}{i}") / F.col(f"k{n}") / UNIT for i in range(len(DIMS))})
        for i, j in _pairs():
            cov = F.col(f"q{n}{i}{j}") / F.col(f"k{n}") / UNIT**2 - F.col(f"mu{n}{i}") * F.col(f"mu{n}{j}") + (FLOORS[i] ** 2 if i == j else 0.0)
            for x in range(j):
                cov = cov - F.col(f"l{n}{i}{x}") * F.col(f"l{n}{j}{x}")
            m = m.withColumn(f"l{n}{i}{j}", F.sqrt(F.greatest(cov, F.lit(1e-12))) if i == j else cov / F.col(f"l{n}{j}{j}"))
    kept = [F.struct(*[F.col(f"mu{n}{i}").alias(f"mu{i}") for i in range(len(DIMS))], *[F.col(f"l{n}{i}{j}").alias(f"l{i}{j}") for i, j in _pairs()]) for n in inside]
    dets = [F.col(f"l{n}00") * F.col(f"l{n}11") * F.col(f"l{n}22") * F.col(f"l{n}33") for n in inside]
    return _small(m.select("group", *[F.struct((det * det).alias("det"), at.alias("at")).alias(f"m{n}") for n, det, at in zip(inside, dets, kept, strict=True)]))


def _distance(at: str) -> Column:
    """Squared Mahalanobis distance from a centre, by forward substitution."""
    y: list[Column] = []
    for i, d in enumerate(DIMS):
        left = F.col(d) / UNIT - F.col(f"{at}.mu{i}")
        for x in range(i):
            left = left - F.col(f"{at}.l{i}{x}") * y[x]
        y.append(left / F.col(f"{at}.l{i}{i}"))
    return F.round(sum((v * v for v in y[1:]), y[0] * y[0]), 9)


def estimates(rows: DataFrame, share: float = SHARE) -> DataFrame:
    """From (group, v1..v4) to group and `at`: the centre and covariance of least determinant that any start reaches, and its `det`."""
    mid = _medians(rows, [f"m_{d}" for d in DIMS])
    off = rows.join(mid, "group").select("group", *[F.abs(F.col(d) - F.col(f"m_{d}")).alias(d) for d in DIMS])
    mad = _medians(off, [f"w_{d}" for d in DIMS])
    scaled = [F.abs(F.col(d) - F.col(f"m_{d}")) / F.greatest(1.4826 * F.col(f"w_{d}"), F.lit(f * UNIT)) for d, f in zip(DIMS, FLOORS, strict=True)]
    starts = (F.greatest(*scaled), sum(scaled[1:], scaled[0]), sum((x * x for x in scaled[1:]), scaled[0] * scaled[0]))
    names = [f"b{n}" for n in range(STARTS)]
    near = rows.join(mid.join(mad, "group"), "group").select("group", *DIMS, *[_log_bin(x).alias(b) for x, b in zip(starts, names, strict=True)])
    best: DataFrame | None = None
    while True:
        limit = _small(_quantiles(near, names, share).select("group", *[F.col(b).alias(f"limit_{b}") for b in names]))
        step = _moments(near.join(limit, "group"), {n: F.col(b) <= F.col(f"limit_{b}") for n, b in enumerate(names)})
        if best is not None:
            both = step.join(best.select("group", *[F.col(f"m{n}").alias(f"o{n}") for n in range(STARTS)]), "group")
            lower = [F.col(f"m{n}.det") < F.col(f"o{n}.det") * (1 - LEAST_GAIN) for n in range(STARTS)]
            picked = [F.when(lower[n], F.col(f"m{n}")).otherwise(F.col(f"o{n}")).alias(f"m{n}") for n in range(STARTS)]
            gained = lower[0] | lower[1] | lower[2]
            step = _small(both.select("group", *picked, gained.alias("gained")))
            if step.where("gained").isEmpty():
                break
        best = step.select("group", *[f"m{n}" for n in range(STARTS)])
        near = rows.join(best, "group").select("group", *DIMS, *[_log_bin(_distance(f"m{n}.at")).alias(b) for n, b in enumerate(names)])
    return step.select("group", F.least(*[F.col(f"m{n}") for n in range(STARTS)]).alias("m")).select("group", "m.at", "m.det")


def robust_distances(rows: DataFrame, fit: DataFrame | None = None, share: float = SHARE) -> DataFrame:
    """From (doc_id, group, v1..v4) to doc_id, group and scaled squared distance; `fit` has the rows that make each group's estimate, else they are the same."""
    fit = rows if fit is None else fit
    at = _small(estimates(fit, share))
    mids = _quantiles(fit.join(at, "group").select("group", _log_bin(_distance("at")).alias("bin")), ["bin"], 0.5)
    scale = _small(mids.select("group", F.greatest(F.lit(1.0), F.exp((F.col("bin") + 1) / 32) / HALF_CHI2).alias("scale")))
    return rows.join(at, "group").join(scale, "group").select("doc_id", "group", (_distance("at") / F.col("scale")).alias("distance"))


def _grouped(rows: DataFrame, least_rows: int) -> tuple[DataFrame, DataFrame]:
    """From (doc_id, lang, source, v1..v4) to the rows with the group that judges them, and the rows (group, v1..v4) that make the estimates."""
    own, lang = F.to_json(F.struct("lang", "source")), F.to_json(F.struct("lang"))
    sizes = rows.groupBy(own.alias("own"), lang.alias("wide")).agg(F.count(F.lit(1)).alias("n"))
    whole = sizes.groupBy("wide").agg(F.sum("n").alias("n_wide"))
    level = F.when(F.col("n") >= least_rows, F.col("own")).when(F.col("n_wide") >= least_rows, F.col("wide")).otherwise(F.lit("all"))
    levels = _small(sizes.join(whole, "wide").select("own", "wide", level.alias("group")))
    placed = materialise(rows.select("doc_id", *DIMS, own.alias("own")).join(levels.select("own", "group", "wide"), "own"))
    fit = placed.where(F.col("group") == F.col("own")).select("group", *DIMS)
    for name in ("wide", "all"):  # only those that some rows are judged by
        used = levels.where(F.col("group") == (F.col("wide") if name == "wide" else F.lit("all"))).select(F.col("group").alias("pool")).distinct()
        pool = F.col("wide") if name == "wide" else F.lit("all")
        fit = fit.unionByName(placed.select(pool.alias("pool"), *DIMS).join(used, "pool").select(F.col("pool").alias("group"), *DIMS))
    return placed.select("doc_id", "group", *DIMS), fit


def judge(docs: DataFrame, cut: float = CUT, least_rows: int = LEAST_ROWS) -> DataFrame:
    """doc_id, the statistics, base_failed, outlier distance (null where the limits failed) and kept; one row per row."""
    rows = base_statistics(docs).withColumn("base_failed", base_failed()).withColumn("row", F.monotonically_increasing_id())
    rows = materialise(rows.select("*", *_vector()))
    judged, fit = _grouped(rows.where("not base_failed").select(F.col("row").alias("doc_id"), "lang", "source", *DIMS), least_rows)
    found = robust_distances(judged, fit).select(F.col("doc_id").alias("row"), "distance")
    out = rows.join(found, "row", "left")
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.round("distance", 6).alias("distance"), (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cut)).alias("kept"),
    )
