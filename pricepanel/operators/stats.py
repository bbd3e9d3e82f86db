"""Statistics over whole columns: one-row aggregates feed the rows as scalar subqueries."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricepanel.functions import scalars as S
from pricepanel.functions.quantiles import exact_quantiles


def log_features(df: DataFrame, offsets: dict[str, float]) -> DataFrame:
    """Add ``log_<column>`` for each column, with its offset; null where the log does not exist."""
    return df.withColumns({f"log_{c}": S.safe_ln(c, offset) for c, offset in offsets.items()})


def complete_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(subset=columns)


def _column_stats(df: DataFrame, columns: list[str], **aggregates):
    """One struct per column with the named aggregates, as a one-row subquery."""
    per_column = [F.struct(*[fn(c).alias(name) for name, fn in aggregates.items()]).alias(c) for c in columns]
    return df.agg(F.struct(*per_column)).scalar()


def standardize(df: DataFrame, columns: list[str]) -> DataFrame:
    """Centre each column and divide by its sample standard deviation."""
    stats = _column_stats(df, columns, mean=F.avg, sd=F.stddev_samp)
    scaled = {c: S.ratio(F.col(c) - F.col(f"__stats.{c}.mean"), f"__stats.{c}.sd") for c in columns}
    return df.withColumn("__stats", stats).withColumns(scaled).drop("__stats")


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pairwise correlations in long form, from one aggregate."""
    pairs = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("corr"))
        for a, b in combinations_with_replacement(columns, 2)
    ]
    return df.agg(F.array(*pairs).alias("__pairs")).select(F.inline("__pairs"))


def histogram(df: DataFrame, columns: list[str], breaks: int = 20) -> DataFrame:
    """Counts in ``breaks`` equal-width bins of each column, all columns in one pass."""
    stats = _column_stats(df, columns, lo=F.min, hi=F.max)

    def bin_of(c: str):
        width = (F.col(f"__stats.{c}.hi") - F.col(f"__stats.{c}.lo")) / F.lit(float(breaks))
        place = F.floor(S.ratio(F.col(c) - F.col(f"__stats.{c}.lo"), width))
        return F.when(F.col(c).isNotNull(), F.least(F.coalesce(place, F.lit(0)), F.lit(breaks - 1)))

    long = F.array(*[F.struct(F.lit(c).alias("column"), bin_of(c).alias("bin")) for c in columns])
    return (
        df.select(*columns).withColumn("__stats", stats)
        .select(F.inline(long))
        .filter(F.col("bin").isNotNull())
        .groupBy("column", "bin")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def quantile_thresholds(df: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """The stated quantile of each column, exact."""
    parts = exact_quantiles(df, list(thresholds), sorted(set(thresholds.values())))
    wanted = [(F.col("column") == c) & (F.col("prob") == p) for c, p in thresholds.items()]
    keep = wanted[0]
    for condition in wanted[1:]:
        keep = keep | condition
    return parts.filter(keep)


def group_profile(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Size, mean and standard deviation of each feature by group, in long form."""
    stats = [
        F.struct(F.lit(c).alias("feature"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd")) for c in columns
    ]
    return (
        df.groupBy(group)
        .agg(F.count(F.lit(1)).alias("size"), F.array(*stats).alias("__stats"))
        .select(group, "size", F.inline("__stats"))
    )


def relabel_by_size(df: DataFrame, group: str) -> DataFrame:
    """Renumber groups so that 1 is the largest; equal sizes keep the order of their old labels.

    A label is the count of groups that come before it, so the few group sizes
    are compared with each other as one array and nothing is sorted globally.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    order = sizes.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col(group).alias("g"))))).scalar()
    labels = F.transform(F.col("__order"), lambda x: x["g"])
    return df.withColumn("__order", order).withColumn(group, F.array_position(labels, F.col(group)).cast("int")).drop("__order")


def nearest_centre(df: DataFrame, columns: list[str], centres: DataFrame, label: str) -> DataFrame:
    """Assign each row to the nearest of a fixed set of centres; ties take the lower label.

    ``centres`` has one row per cluster. The centres ride along as one array.
    """
    point = F.struct(F.col(label).alias("label"), F.array(*[F.col(c) for c in columns]).alias("at"))
    packed = centres.agg(F.array_sort(F.collect_list(point))).scalar()
    own = F.array(*[F.col(c) for c in columns])
    squares = lambda at: F.aggregate(
        F.zip_with(own, at, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda total, x: total + x
    )
    scored = F.transform(F.col("__centres"), lambda c: F.struct(squares(c["at"]).alias("d"), c["label"].alias("label")))
    return (
        df.withColumn("__centres", packed)
        .withColumn("__best", F.array_min(scored))
        .withColumns({label: F.col("__best.label"), "distance": F.sqrt("__best.d")})
        .drop("__centres", "__best")
    )


def ols_two(df: DataFrame, y: str, x1: str, x2: str) -> DataFrame:
    """Least squares on two regressors from one aggregate of means and covariances."""
    cov = lambda a, b: F.covar_samp(a, b)
    sums = df.dropna(subset=[y, x1, x2]).agg(
        F.avg(y).alias("my"), F.avg(x1).alias("m1"), F.avg(x2).alias("m2"),
        cov(x1, x1).alias("s11"), cov(x2, x2).alias("s22"), cov(x1, x2).alias("s12"),
        cov(x1, y).alias("s1y"), cov(x2, y).alias("s2y"), F.count(F.lit(1)).alias("n"),
    )
    det = F.col("s11") * F.col("s22") - F.col("s12") * F.col("s12")
    slopes = sums.withColumns(
        {
            "b1": S.ratio(F.col("s1y") * F.col("s22") - F.col("s2y") * F.col("s12"), det),
            "b2": S.ratio(F.col("s2y") * F.col("s11") - F.col("s1y") * F.col("s12"), det),
        }
    )
    intercept = F.col("my") - F.col("b1") * F.col("m1") - F.col("b2") * F.col("m2")
    terms = [("(Intercept)", intercept), (x1, F.col("b1")), (x2, F.col("b2"))]
    rows = F.array(*[F.struct(F.lit(t).alias("term"), e.alias("estimate")) for t, e in terms])
    return slopes.select("n", F.inline(rows))


def residuals_two(df: DataFrame, y: str, x1: str, x2: str, out: str = "residual") -> DataFrame:
    """Add the residual of `ols_two`."""
    rows = df.dropna(subset=[y, x1, x2])
    fit = ols_two(rows, y, x1, x2).agg(F.map_from_entries(F.collect_list(F.struct("term", "estimate")))).scalar()
    b = lambda term: F.element_at(F.col("__fit"), F.lit(term))
    predicted = b("(Intercept)") + b(x1) * F.col(x1) + b(x2) * F.col(x2)
    return rows.withColumn("__fit", fit).withColumn(out, F.col(y) - predicted).drop("__fit")


def group_effects(df: DataFrame, value: str, group: str) -> DataFrame:
    """Random-intercept effects by moments: each group mean shrunk by its reliability.

    Between and within variance come from the group counts, means and
    variances; the result is ``n * sb / (n * sb + sw) * mean`` per group. This is
    not a REML fit and its effects differ from one.
    """
    groups = df.groupBy(F.col(group).alias("level")).agg(
        F.count(value).alias("n"), F.avg(value).alias("m"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("v")
    )
    sums = groups.agg(
        F.struct(
            F.sum("n").cast("double").alias("rows"),
            F.count(F.lit(1)).cast("double").alias("groups"),
            F.sum(F.col("n") * F.col("n")).cast("double").alias("squares"),
            F.sum((F.col("n") - 1) * F.col("v")).alias("within"),
            F.sum(F.col("n") * F.col("m")).alias("total"),
            F.sum(F.col("n") * F.col("m") * F.col("m")).alias("between"),
        )
    ).scalar()
    t = lambda f: F.col(f"__t.{f}")
    within = S.ratio(t("within"), t("rows") - t("groups"))
    mean_square = S.ratio(t("between") - S.ratio(t("total") * t("total"), t("rows")), t("groups") - 1)
    size = S.ratio(t("rows") - S.ratio(t("squares"), t("rows")), t("groups") - 1)
    return (
        groups.withColumn("__t", sums)
        .withColumns({"__sw": within, "__sb": F.greatest(S.ratio(mean_square - within, size), F.lit(0.0))})
        .withColumn("effect", S.ratio(F.col("n") * F.col("__sb"), F.col("n") * F.col("__sb") + F.col("__sw")) * F.col("m"))
        .select("level", "n", "effect")
    )


def shrunken_effects(df: DataFrame, value: str, first: str, second: str) -> DataFrame:
    """Effects of two factors in turn: the second from what the first leaves over."""
    one = group_effects(df, value, first)
    left = df.join(one.select(F.col("level").alias(first), F.col("effect").alias("__e")), [first]).withColumn(
        value, F.col(value) - F.col("__e")
    )
    two = group_effects(left, value, second)
    return one.withColumn("factor", F.lit(first)).unionByName(two.withColumn("factor", F.lit(second)))
