"""Relational reports: estimates held against actual runs, group statistics, completeness checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NUMERIC = ("int", "bigint", "smallint", "tinyint", "float", "double")


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key combinations that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("count")).where("count > 1")


def require_unique(df: DataFrame, keys: list[str], what: str = "rows") -> None:
    bad = repeated_keys(df, keys).limit(3).collect()
    if bad:
        raise ValueError(f"{what} repeat {bad}")


def require_columns(df: DataFrame, columns: list[str]) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def latest(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """The union of frames in which a later one's row replaces an earlier one's of the same keys."""
    u = union_all([f.withColumn("_at", F.lit(i)) for i, f in enumerate(frames)])
    return u.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_at")))).where("_r = 1").drop("_r", "_at")


def missing_combinations(df: DataFrame, expected: dict[str, list]) -> DataFrame:
    """Expected combinations that df lacks; the lists are experiment grids."""
    grid = None
    for name, values in expected.items():
        own = df.sparkSession.createDataFrame([(v,) for v in values], f"{name} {dict(df.dtypes)[name]}")
        grid = own if grid is None else grid.crossJoin(own)
    return grid.join(df.select(*expected), list(expected), "left_anti")


def align(df: DataFrame, total: str = "estimated_total_ios", per: str = "estimated_ios", queries: str = "queries", estimated: str = "estimate_queries") -> DataFrame:
    """df + estimated_total_ios_for_actual_queries and query_count_delta: estimates scaled to the queries that
    ran; where the per-query estimate is missing, from the total, and else the total as it is."""
    per_query = F.coalesce(F.col(per), F.col(total) / F.nullif(F.col(estimated), F.lit(0)))
    return df.withColumns({"estimated_total_ios_for_actual_queries": F.coalesce(per_query * F.col(queries), F.col(total)), "query_count_delta": F.col(queries) - F.col(estimated)})


def with_accuracy(df: DataFrame, actual: str, estimate: str) -> DataFrame:
    """df + absolute_error, relative_error, accuracy in [0, 1] and q_error; null where the actual is not above 0."""
    a, e = F.col(actual), F.col(estimate)
    df = df.withColumn("absolute_error", F.abs(e - a)).withColumn("relative_error", F.when(a > 0, F.abs(e - a) / a))
    df = df.withColumn("accuracy", F.least(F.greatest(1 - F.col("relative_error"), F.lit(0.0)), F.lit(1.0)))
    return df.withColumn("q_error", F.when((a > 0) & (e > 0), F.greatest(e / a, a / e)))


def accuracy_summary(actual: DataFrame, estimate: DataFrame, keys: list[str], group: list[str], eps: list[int] | None = None, more: list[str] = ()) -> DataFrame:
    """actual joined with estimate on keys, errors per row, means per group, in group order. Keys must be
    unique on both sides; ``more`` columns get their means."""
    require_unique(actual, keys, "actual rows")
    require_unique(estimate, keys, "estimates")
    m = actual.join(estimate, keys)
    if eps is not None:
        m = m.where(F.col("epsilon").isin(eps))
    m = with_accuracy(align(m), "actual_total_ios", "estimated_total_ios_for_actual_queries")
    return m.groupBy(*group).agg(
        F.avg("accuracy").alias("mean_accuracy"), F.avg("relative_error").alias("mean_relative_error"), F.count("epsilon").alias("epsilon_points"),
        F.avg("actual_total_ios").alias("mean_actual_total_ios"), F.avg("estimated_total_ios_for_actual_queries").alias("mean_estimated_total_ios"),
        F.avg("query_count_delta").alias("mean_query_count_delta"), F.max("queries").alias("actual_queries"), F.max("estimate_queries").alias("estimate_queries"),
        *[F.avg(c).alias(f"mean_{c}") for c in more],
    ).orderBy(*group)


def sampling_comparison(methods: DataFrame, keys: list[str], truth_method: str = "REPLAY", truth_rate: float = 100.0, set_up_once: tuple[str, ...] = ("MODEL",)) -> DataFrame:
    """methods (keys, method, rate, ios, setup_s): each against the full replay of its keys, then per (method,
    rate): rows, mean relative and q-error, setup time (the greatest for methods that set up once, else the sum)."""
    truth = methods.where((F.col("method") == truth_method) & (F.col("rate") == truth_rate)).select(*keys, F.col("ios").alias("true_ios"))
    m = with_accuracy(methods.join(truth, keys, "left"), "true_ios", "ios")
    setup = F.when(F.first("method").isin(*set_up_once), F.max("setup_s")).otherwise(F.sum("setup_s"))
    return m.groupBy("method", "rate").agg(F.count("*").alias("rows"), F.avg("relative_error").alias("mean_relative_error"), F.avg("q_error").alias("mean_q_error"), F.max("q_error").alias("max_q_error"), setup.alias("setup_s"))


def formula_baseline(actual: DataFrame, ipp: int = 512) -> DataFrame:
    """What a model without a cache says: 1 + 2 eps / ipp pages for each query."""
    per = 1 + 2 * F.col("epsilon") / ipp
    return actual.withColumns({"method": F.lit("SIMPLE_LPM"), "ios": per * F.col("queries")})


def merge_diagnostics(left: DataFrame, right: DataFrame, keys: list[str], by: str = "M") -> DataFrame:
    """By ``by``: rows on both sides, only left, only right, of a full outer merge on keys."""
    l_, r = left.select(*keys).distinct().withColumn("_l", F.lit(1)), right.select(*keys).distinct().withColumn("_r", F.lit(1))
    m = l_.join(r, keys, "full_outer")
    has = lambda a, b: F.sum(F.when((F.col("_l").isNotNull() == a) & (F.col("_r").isNotNull() == b), 1).otherwise(0)).cast("bigint")
    return m.groupBy(by).agg(has(True, True).alias("both"), has(True, False).alias("left_only"), has(False, True).alias("right_only"))


def merge_filled(left: DataFrame, right: DataFrame, keys: list[str], fill: dict[str, list[str]]) -> DataFrame:
    """left joined one to one with right; a missing value takes the first of its group (by keys)."""
    require_unique(left, keys)
    require_unique(right, keys)
    m = left.join(right, keys, "left")
    for col, group in fill.items():
        w = Window.partitionBy(*group).orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        m = m.withColumn(col, F.coalesce(F.col(col), F.first(col, ignorenulls=True).over(w)))
    return m


def overlay(base: DataFrame, override: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """base with override's values where it has them."""
    o = override.select(*keys, *[F.col(c).alias(f"_{c}") for c in cols])
    return base.join(o, keys, "left").select(*keys, *[F.coalesce(f"_{c}", c).alias(c) if c in cols else c for c in base.columns if c not in keys])


def percentiles(df: DataFrame, value: str, ranks=(50, 90, 95, 99), by: list[str] = ()) -> DataFrame:
    """mean, population deviation, min, max and nearest-rank percentiles: the ceil(p / 100 n)-th value."""
    per = [F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY {value})").alias(f"p{p}") for p in ranks]
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), *per)


def fractions(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """(by, value, count, fraction): the histogram of a column."""
    c = df.groupBy(*by, value).agg(F.count("*").alias("count"))
    t = c.groupBy(*by).agg(F.sum("count").alias("_n"))
    return (c.join(t, list(by)) if by else c.crossJoin(t)).withColumn("fraction", F.col("count") / F.col("_n")).drop("_n")


def mode_of(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The most frequent value of each group; ties to the smaller number, then to the smaller text."""
    c = df.groupBy(*by, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by).orderBy(F.desc("_n"), F.col(value).cast("string").try_cast("double").asc_nulls_last(), F.col(value).cast("string"))
    return c.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_n")


def aggregate_repeats(df: DataFrame, by: list[str], modes: list[str] = ()) -> DataFrame:
    """Of repeated runs: mean and population deviation of numbers, the mode of ``modes``, of other columns
    the value, or 'varies', and the number of rows."""
    rest = [(c, t) for c, t in df.dtypes if c not in by and c not in modes]
    aggs = [F.count("*").alias("repeats")]
    for c, t in rest:
        if t in NUMERIC:
            aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std")]
        else:
            aggs.append(F.when(F.count_distinct(c) == 1, F.min(c)).otherwise(F.lit("varies")).alias(c))
    out = df.groupBy(*by).agg(*aggs)
    for m in modes:
        out = out.join(mode_of(df, by, m), by)
    return out


def average_repeats(df: DataFrame, by: list[str], repeat: str = "repeat") -> DataFrame:
    """Means of numbers, other columns from the first repeat, and the distinct repeats."""
    rest = [(c, t) for c, t in df.dtypes if c not in (*by, repeat)]
    return df.groupBy(*by).agg(*[(F.avg(c) if t in NUMERIC else F.min_by(c, repeat)).alias(c) for c, t in rest], F.count_distinct(repeat).alias("repeats"))


def latency_parts(df: DataFrame, parts: list[str], wall: str, tolerance: float = 1e-6) -> DataFrame:
    """df + other: what of the wall time the parts leave; parts that exceed it are an error."""
    s = reduce(lambda a, b: a + b, [F.col(p) for p in parts])
    bad = df.where(s > F.col(wall) * (1 + tolerance)).limit(1).count()
    if bad:
        raise ValueError("parts exceed the wall time")
    return df.withColumn("other", F.col(wall) - s)


def state_space_rows(estimate: DataFrame, simulated: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Estimate beside simulation: each column's difference and relative error, NaN against a 0."""
    from pagelore.functions.labels import safe_relative_error

    s = simulated.select(*keys, *[F.col(c).alias(f"sim_{c}") for c in cols])
    m = estimate.select(*keys, *cols).join(s, keys)
    return m.withColumns({f"{k}_{c}": f(c) for c in cols for k, f in (("abs", lambda c: F.abs(F.col(c) - F.col(f"sim_{c}"))), ("rel", lambda c: safe_relative_error(F.col(c), F.col(f"sim_{c}"))))})


def coverage(df: DataFrame, error: str, by=("M", "policy")) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.avg(error).alias("mean_error"), F.max(error).alias("max_error"))


def in_range(c: Column, lo, hi) -> Column:
    return c.between(lo, hi)
