"""Result files of experiments: replay summaries, estimate logs and bench tables as typed rows.

Files are CSV with a header. Headers are brought to one form (lower case, words joined by _), numbers that
don't parse are null, policies are upper case, memory budgets are whole MiB. A file, a folder or a glob may
hold many files; what a file's name says (dataset, policy, budget) is taken from each row's own file.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.functions.labels import dataset_key, dataset_label, memory_mib
from pagelore.operators.report import require_columns

#: Patterns of file names.
ESTIMATE_LOG = r"(?i)^(.+)_(FIFO|LRU|LFU|NONE)\.log$"
BENCH_FILE = r"(?i)^(.+)_M(\d+)(?:_range)?_bench(?:_[^.]+)?\.csv$"
SUMMARY_FILE = r"(?i)^(.+)_M(\d+)_q30_summary\.csv$"
#: Columns that may hold the measured page reads of a query.
IO_COLUMN = r"(actual_)?(avg|mean)_(\w+_)?ios?"


def header(name: str) -> str:
    return re.sub("[^0-9a-z]+", "_", name.strip().lower()).strip("_")


def read(spark: SparkSession, path, required=()) -> DataFrame:
    """The rows of CSV files as text under normalised headers, with file, the name of a row's file."""
    rows = spark.read.csv(path, header=True, inferSchema=False)
    names = [header(c) for c in rows.columns]
    rows = rows.toDF(*names)
    require_columns(rows, list(required))
    return rows.withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))


def number(name: str) -> Column:
    return F.trim(F.col(name)).try_cast("double")


def whole(name: str) -> Column:
    return number(name).cast("bigint")


def io_column(df: DataFrame) -> str:
    """The column of page reads a query; the first that is called so."""
    found = [c for c in df.columns if re.fullmatch(IO_COLUMN, c)]
    if not found:
        raise ValueError("no column of page reads a query")
    return found[0]


def _of(rows: DataFrame, policy: str | None, strategy: str | None, budget_mode: str | None) -> DataFrame:
    for col, value, form in (("policy", policy, F.upper), ("strategy", strategy, F.lower), ("budget_mode", budget_mode, F.lower)):
        if value is not None and col in rows.columns:
            rows = rows.where(form(F.trim(F.col(col))) == (value.upper() if form is F.upper else value.lower()))
    return rows.withColumn("policy", F.upper(F.trim(F.col("policy")))) if "policy" in rows.columns else rows


def _labels(dataset: str, workload: str) -> list[Column]:
    return [F.lit(dataset).alias("dataset"), dataset_label(F.lit(dataset)).alias("dataset_label"), F.lit(workload).alias("workload")]


def _count(rows: DataFrame) -> Column:
    """Queries of a point file, ranges of a range file."""
    found = [c for c in ("queries", "ranges") if c in rows.columns]
    if not found:
        raise ValueError("neither queries nor ranges")
    return whole(found[0])


def actual_rows(spark, path, dataset: str, workload: str, policy: str, strategy: str | None = None, budget_mode: str = "estimated") -> DataFrame:
    """Replay results of points or ranges: (dataset, dataset_label, workload, M, epsilon, policy, strategy, queries,
    actual_total_ios, actual_avg_io, simulate_s, index_build_s) of one policy, budget mode and, if given, strategy."""
    rows = read(spark, path, ["epsilon", "policy", "memory_budget_bytes", "total_cache_misses"])
    io, n = io_column(rows), _count(rows)
    rows = _of(rows, policy, strategy, budget_mode)
    seconds = lambda c: (number(c) / 1e9 if c in rows.columns else F.lit(None).cast("double"))
    return rows.select(
        *_labels(dataset, workload), memory_mib(number("memory_budget_bytes")).alias("M"), whole("epsilon").cast("int").alias("epsilon"), "policy",
        (F.trim("strategy") if "strategy" in rows.columns else F.lit(None).cast("string")).alias("strategy"), n.alias("queries"), number("total_cache_misses").alias("actual_total_ios"),
        number(io).alias("actual_avg_io"), seconds("simulate_wall_ns").alias("simulate_s"), seconds("index_build_ns").alias("index_build_s"),
    )


def replay_rows(spark, path, dataset: str, workload: str, rate: float, m_mib: int, policy: str, strategy: str | None = None) -> DataFrame:
    """Replays of a prefix of ``rate`` percent as estimates: one row each with method replay and its rate."""
    a = actual_rows(spark, path, dataset, workload, policy, strategy)
    return a.select(
        F.lit("replay").alias("method"), "dataset", "dataset_label", "workload", F.lit(float(rate)).alias("sample_rate_percent"), F.lit(rate / 100.0).alias("sample_fraction"),
        F.lit(int(m_mib)).alias("M"), "epsilon", "policy", "strategy", F.col("queries").alias("sample_queries"), F.col("actual_total_ios").alias("sample_total_ios"),
        F.col("actual_avg_io").alias("estimated_avg_io"), F.col("simulate_s").alias("estimate_core_s"), F.col("index_build_s").alias("estimate_setup_s"),
        (F.col("simulate_s") + F.col("index_build_s")).alias("estimate_s"), F.lit(False).alias("setup_shared"),
    )


def estimate_rows(spark, path, policy: str, strategy: str | None = None) -> DataFrame:
    """Estimates that were written with their labels, of one policy and strategy; numbers are typed."""
    rows = _of(read(spark, path, ["method", "m", "epsilon", "policy", "estimated_avg_io"]), policy, strategy, None)
    text = ("method", "dataset", "dataset_label", "workload", "sample_label", "policy", "strategy", "file")
    return rows.select(*[c if c in text else (whole(c).cast("int").alias("M" if c == "m" else c) if c in ("m", "epsilon") else number(c).alias(c)) for c in rows.columns if c != "file"])


def estimate_logs(spark, path) -> DataFrame:
    """Logs of (M, epsilon, cost, ratio) whose names give dataset and policy; incomplete rows and other files go."""
    rows = read(spark, path, ["m", "epsilon", "cost", "ratio"]).where(F.col("file").rlike(ESTIMATE_LOG))
    out = rows.select(
        dataset_key(F.regexp_extract("file", ESTIMATE_LOG, 1)).alias("dataset_key"), F.upper(F.regexp_extract("file", ESTIMATE_LOG, 2)).alias("policy"), whole("m").cast("int").alias("M"), whole("epsilon").cast("int").alias("epsilon"),
        number("cost").alias("estimated_avg_ios"), number("ratio").alias("estimated_hit_ratio"), F.col("file").alias("estimate_source"),
    )
    return out.dropna(subset=["M", "epsilon", "estimated_avg_ios", "estimated_hit_ratio"])


def bench_rows(spark, path) -> DataFrame:
    """Bench tables of points or ranges: totals, means per query, hit ratio and throughput. The budget is a column or
    in the file's name; means that are missing come from the totals; incomplete rows go."""
    rows = read(spark, path, ["epsilon", "policy", "hit_ratio", "logical_ios", "throughput_qps"])
    n, kind = _count(rows), "point" if "queries" in rows.columns else "range"
    m = whole("m") if "m" in rows.columns else F.nullif(F.regexp_extract("file", BENCH_FILE, 2), F.lit("")).cast("bigint")
    per = number("avg_logical_ios") if "avg_logical_ios" in rows.columns else F.lit(None).cast("double")
    base = F.when(F.col("file").rlike(BENCH_FILE), F.regexp_extract("file", BENCH_FILE, 1)).otherwise(F.col("file"))
    out = rows.select(
        dataset_key(base).alias("dataset_key"), F.upper(F.trim("policy")).alias("policy"), m.cast("int").alias("M"), whole("epsilon").cast("int").alias("epsilon"), n.alias("queries"),
        number("logical_ios").alias("actual_total_ios"), F.coalesce(per, number("logical_ios") / F.nullif(n, F.lit(0))).alias("actual_avg_ios"), number("hit_ratio").alias("actual_hit_ratio"),
        number("throughput_qps").alias("actual_throughput_qps"), F.lit(kind).alias("workload_type"), F.col("file").alias("bench_source"),
    )
    return out.dropna(subset=["M", "epsilon", "queries", "actual_hit_ratio", "actual_total_ios", "actual_throughput_qps", "policy"])


def query_counts(spark, path, dataset: str, policy: str) -> DataFrame:
    """(policy, M, epsilon, queries, source) of the summaries whose names are dataset and budget."""
    rows = _of(read(spark, path, ["epsilon", "policy", "queries"]), policy, None, None).where(F.lower(F.regexp_extract("file", SUMMARY_FILE, 1)) == dataset.lower())
    out = rows.select("policy", F.regexp_extract("file", SUMMARY_FILE, 2).cast("int").alias("M"), whole("epsilon").cast("int").alias("epsilon"), whole("queries").alias("queries"), F.col("file").alias("source"))
    return out.dropna(subset=["epsilon", "queries"])


def simulation_rows(spark, path, strategy: str) -> DataFrame:
    """(epsilon, policy, queries, actual_hit_ratio, actual_avg_ios, wall_s, throughput_qps) of one strategy."""
    rows = read(spark, path, ["epsilon", "policy", "strategy", "queries", "global_hit_ratio", "wall_ns", "throughput_qps"])
    io = io_column(rows)
    return _of(rows, None, strategy, None).select(whole("epsilon").cast("int").alias("epsilon"), "policy", number("queries").alias("queries"), number("global_hit_ratio").alias("actual_hit_ratio"), number(io).alias("actual_avg_ios"), (number("wall_ns") / 1e9).alias("wall_s"), number("throughput_qps").alias("throughput_qps"))


def mean_by_epsilon(spark, path, policy: str, strategy: str, max_eps: int) -> DataFrame:
    """(epsilon, avg_ios): the mean page reads a query of each epsilon up to max_eps, in order."""
    rows = read(spark, path, ["epsilon"])
    io = io_column(rows)
    rows = _of(rows, policy, strategy, None).select(whole("epsilon").cast("int").alias("epsilon"), number(io).alias("io")).where(F.col("epsilon") <= max_eps)
    return rows.groupBy("epsilon").agg(F.avg("io").alias("avg_ios")).orderBy("epsilon")


def revision_curve(revised: DataFrame, original: DataFrame | None, actual: DataFrame, policy: str) -> DataFrame:
    """revised (M, epsilon, corrected_cost, residual) beside original estimates (M, epsilon, estimated_cost), or, without
    them, beside corrected_cost - residual; then a full outer join with actual (policy, M, epsilon, queries,
    actual_total_ios); totals by the first query count of each budget, budgets without one go."""
    if original is None:
        r = revised.withColumn("estimated_cost", F.col("corrected_cost") - F.col("residual"))
    else:
        r = revised.join(original.select("M", "epsilon", "estimated_cost"), ["M", "epsilon"])
    own = actual.where(F.upper("policy") == policy.upper())
    counts = own.dropna(subset=["queries"]).groupBy("M").agg(F.min_by("queries", "epsilon").alias("full_queries"))
    m = r.join(own.dropna(subset=["actual_total_ios"]).select("M", "epsilon", "actual_total_ios"), ["M", "epsilon"], "full_outer").join(counts, "M")
    total = lambda c: F.col(c) * F.col("full_queries")
    m = m.withColumns({"policy": F.lit(policy.upper()), "estimated_total_ios": total("estimated_cost"), "corrected_total_ios": total("corrected_cost")})
    return m.withColumns({"error_before": F.col("estimated_total_ios") - F.col("actual_total_ios"), "error_after": F.col("corrected_total_ios") - F.col("actual_total_ios")})


def limited_metadata(metadata: DataFrame, records: DataFrame) -> DataFrame:
    """(name, value) lines with num_queries as many as there are records."""
    n = records.agg(F.count("*").cast("string").alias("_n"))  # one row
    return metadata.crossJoin(n).select("name", F.when(F.col("name") == "num_queries", F.col("_n")).otherwise(F.col("value")).alias("value"))
