"""Queries that write result files to the shared folder and load them. Orders stand for runs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pagelore.operators import cache, costs, keys, report, tune, workload
from pagelore.plans import inputs as I
from pagelore.plans.base import query
from pagelore.plans.cost_queries import RANGE_RANKS, RANKS, _weights, range_ranks
from pagelore.runtime import shared_dir, table
from pagelore.sources import results

RUNS = """runs AS (SELECT o_orderkey AS k, (o_orderkey % 8 * 8)::INTEGER AS eps, CASE WHEN o_custkey % 2 = 0 THEN 'lru' ELSE 'FIFO' END AS pol, CASE WHEN o_custkey % 3 = 0 THEN 'one_by_one' ELSE 'all_in_once' END AS strat,
  CASE WHEN o_orderkey % 5 = 0 THEN 'RAW' ELSE 'Estimated' END AS mode, 1048576 * (o_orderkey % 4 + 1) + o_custkey % 1000 AS bytes, o_custkey + 10 AS q, o_orderkey * 3 AS misses FROM orders)"""


def _runs(spark, d):
    o = table(spark, d, "orders")
    return o.select(
        (F.col("o_orderkey") % 8 * 8).alias("Epsilon"), F.when(F.col("o_custkey") % 2 == 0, "lru").otherwise("FIFO").alias("Policy"), F.when(F.col("o_custkey") % 3 == 0, "one_by_one").otherwise("all_in_once").alias("strategy"),
        F.when(F.col("o_orderkey") % 5 == 0, "RAW").otherwise("Estimated").alias("Budget Mode"), (1048576 * (F.col("o_orderkey") % 4 + 1) + F.col("o_custkey") % 1000).alias("memory_budget_bytes"), (F.col("o_custkey") + 10).alias("queries"),
        (F.col("o_orderkey") * 3).alias("total cache misses"), (F.col("o_orderkey") * 3 / (F.col("o_custkey") + 10)).alias("avg_io"), (F.col("o_orderkey") * 1000).alias("simulate_wall_ns"), (F.col("o_custkey") * 1000).alias("index_build_ns"), F.col("o_orderkey").alias("k"),
    )


def _written(spark, rows, name=None):
    """A CSV of rows in the shared folder; with a name, one file of that name."""
    path = f"{shared_dir(spark)}/results-{uuid.uuid4().hex}"
    if name is None:
        rows.write.csv(path, header=True)
        return path
    rows.coalesce(1).write.csv(path, header=True)
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(f.getPath() for f in fs.listStatus(at) if f.getPath().getName().startswith("part-"))
    fs.rename(part, hadoop.Path(at, name))
    return path


@query(f"WITH {RUNS} SELECT 'books_200M' AS dataset, 'books' AS dataset_label, 'w4' AS workload, round(bytes / 1048576)::INTEGER AS M, eps AS epsilon, 'LRU' AS policy, strat AS strategy, q AS queries, misses::DOUBLE AS actual_total_ios, round(misses / q, 9) AS actual_avg_io, k * 1000 / 1e9 AS simulate_s FROM runs WHERE pol = 'lru' AND mode = 'Estimated'")
def load_actual(spark, d):
    a = results.actual_rows(spark, _written(spark, _runs(spark, d)), "books_200M", "w4", "lru")
    return a.withColumn("actual_avg_io", F.round("actual_avg_io", 9)).drop("index_build_s")


@query(f"WITH {RUNS} SELECT 'x' AS dataset, 'w1' AS workload, round(bytes / 1048576)::INTEGER AS M, eps AS epsilon, strat AS strategy, q AS queries, misses::DOUBLE AS actual_total_ios FROM runs WHERE pol = 'FIFO' AND mode = 'Estimated' AND strat = 'one_by_one'")
def load_actual_ranges(spark, d):
    """A range file: its count is called ranges."""
    a = results.actual_rows(spark, _written(spark, _runs(spark, d).withColumnRenamed("queries", "Ranges")), "x", "w1", "FIFO", "one_by_one")
    return a.select("dataset", "workload", "M", "epsilon", "strategy", "queries", "actual_total_ios")


@query(f"WITH {RUNS} SELECT 'replay' AS method, 10.0::DOUBLE AS sample_rate_percent, 0.1::DOUBLE AS sample_fraction, 64 AS M, eps AS epsilon, 'LRU' AS policy, q AS sample_queries, misses::DOUBLE AS sample_total_ios, round(misses / q, 9) AS estimated_avg_io, false AS setup_shared FROM runs WHERE pol = 'lru' AND mode = 'Estimated' AND strat = 'all_in_once'")
def load_replays(spark, d):
    r = results.replay_rows(spark, _written(spark, _runs(spark, d)), "x", "w1", 10.0, 64, "LRU", "all_in_once")
    return r.select("method", "sample_rate_percent", "sample_fraction", "M", "epsilon", "policy", "sample_queries", "sample_total_ios", F.round("estimated_avg_io", 9).alias("estimated_avg_io"), "setup_shared")


@query("SELECT 'model' AS method, (o_orderkey % 4)::INTEGER AS M, (o_orderkey % 8)::INTEGER AS epsilon, 'LRU' AS policy, 'all_in_once' AS strategy, o_custkey::DOUBLE AS estimated_avg_io FROM orders WHERE o_custkey % 2 = 0")
def load_estimates(spark, d):
    o = table(spark, d, "orders").select(F.lit("model").alias("method"), (F.col("o_orderkey") % 4).alias("M"), (F.col("o_orderkey") % 8).alias("epsilon"), F.when(F.col("o_custkey") % 2 == 0, "lru").otherwise("lfu").alias("policy"), F.lit("all_in_once").alias("strategy"), F.col("o_custkey").alias("estimated_avg_io"))
    return results.estimate_rows(spark, _written(spark, o), "LRU", "all_in_once")


@query("SELECT 'books' AS dataset_key, 'LFU' AS policy, (o_orderkey % 4)::INTEGER AS M, (o_orderkey % 8)::INTEGER AS epsilon, o_custkey::DOUBLE AS estimated_avg_ios, 0.5::DOUBLE AS estimated_hit_ratio, 'books_uint64_lfu.log' AS estimate_source FROM orders WHERE o_custkey % 7 <> 0")
def load_estimate_logs(spark, d):
    """Rows whose cost is no number go; dataset and policy are in the name."""
    o = table(spark, d, "orders").select((F.col("o_orderkey") % 4).alias(" M "), (F.col("o_orderkey") % 8).alias("Epsilon"), F.when(F.col("o_custkey") % 7 == 0, "nan?").otherwise(F.col("o_custkey").cast("string")).alias("Cost"), F.lit(0.5).alias("ratio"))
    return results.estimate_logs(spark, _written(spark, o, "books_uint64_lfu.log"))


@query(f"WITH {RUNS} SELECT 'osm' AS dataset_key, upper(pol) AS policy, 96 AS M, eps AS epsilon, q AS queries, misses::DOUBLE AS actual_total_ios, round(misses / q, 9) AS actual_avg_ios, 0.25::DOUBLE AS actual_hit_ratio, k::DOUBLE AS actual_throughput_qps, 'range' AS workload_type, 'osm_M96_range_bench_a.csv' AS bench_source FROM runs")
def load_bench(spark, d):
    r = _runs(spark, d).select("Epsilon", "Policy", F.col("queries").alias("ranges"), F.col("total cache misses").alias("logical ios"), F.lit(0.25).alias("hit_ratio"), F.col("k").alias("throughput_qps"))
    b = results.bench_rows(spark, _written(spark, r, "osm_M96_range_bench_a.csv"))
    return b.withColumn("actual_avg_ios", F.round("actual_avg_ios", 9))


@query(f"WITH {RUNS} SELECT 'FIFO' AS policy, 128 AS M, eps AS epsilon, q AS queries, 'fb_M128_q30_summary.csv' AS source FROM runs WHERE pol = 'FIFO'")
def load_query_counts(spark, d):
    return results.query_counts(spark, _written(spark, _runs(spark, d).select("Epsilon", "Policy", "queries"), "fb_M128_q30_summary.csv"), "fb", "fifo")


@query(f"WITH {RUNS} SELECT eps AS epsilon, upper(pol) AS policy, q::DOUBLE AS queries, 0.5::DOUBLE AS actual_hit_ratio, round(misses / q, 9) AS actual_avg_ios, k * 1000 / 1e9 AS wall_s, 7.0::DOUBLE AS throughput_qps FROM runs WHERE strat = 'one_by_one'")
def load_simulations(spark, d):
    r = _runs(spark, d).select("Epsilon", "Policy", "strategy", "queries", F.lit(0.5).alias("global_hit_ratio"), F.col("avg_io").alias("mean_io"), F.col("simulate_wall_ns").alias("wall_ns"), F.lit(7.0).alias("throughput_qps"))
    return results.simulation_rows(spark, _written(spark, r), "one_by_one").withColumn("actual_avg_ios", F.round("actual_avg_ios", 9))


@query(f"WITH {RUNS} SELECT eps AS epsilon, round(avg(misses / q), 6) AS avg_ios FROM runs WHERE pol = 'lru' AND strat = 'all_in_once' AND eps <= 40 GROUP BY eps")
def load_means_by_epsilon(spark, d):
    return results.mean_by_epsilon(spark, _written(spark, _runs(spark, d)), "LRU", "all_in_once", 40).withColumn("avg_ios", F.round("avg_ios", 6))


@query(
    """WITH r AS (SELECT (o_orderkey % 5)::INTEGER AS M, (o_orderkey % 8)::INTEGER AS epsilon, count(*) / 3 AS corrected_cost, count(*) / 30 AS residual FROM orders WHERE o_orderkey % 8 < 6 GROUP BY ALL),
a AS (SELECT (o_orderkey % 4)::INTEGER AS M, (o_orderkey % 8)::INTEGER AS epsilon, sum(o_custkey)::DOUBLE AS actual_total_ios, count(*) AS queries FROM orders GROUP BY ALL),
c AS (SELECT M, arg_min(queries, epsilon) AS full_queries FROM a GROUP BY M)
SELECT M, epsilon, round(corrected_cost * full_queries, 4) AS corrected_total_ios, coalesce(round((corrected_cost - residual) * full_queries - actual_total_ios, 4), 0) AS error_before, coalesce(round(corrected_cost * full_queries - actual_total_ios, 4), 0) AS error_after FROM r FULL JOIN a USING (M, epsilon) JOIN c USING (M) WHERE corrected_cost IS NOT NULL"""
)
def revision_curve(spark, d):
    """Revised estimates without an original log, in a full outer join with the measured ones."""
    o = table(spark, d, "orders")
    key = lambda m: [(F.col("o_orderkey") % m).cast("int").alias("M"), (F.col("o_orderkey") % 8).cast("int").alias("epsilon")]
    r = o.where("o_orderkey % 8 < 6").groupBy(*key(5)).agg((F.count("*") / 3).alias("corrected_cost"), (F.count("*") / 30).alias("residual"))
    a = o.groupBy(*key(4)).agg(F.sum("o_custkey").cast("double").alias("actual_total_ios"), F.count("*").alias("queries")).withColumn("policy", F.lit("lru"))
    c = results.revision_curve(r, None, a, "LRU").where("corrected_cost is not null")
    return c.select("M", "epsilon", *[F.coalesce(F.round(x, 4), F.lit(0.0)).alias(x) for x in ("corrected_total_ios", "error_before", "error_after")])


@query("SELECT name, CASE WHEN name = 'num_queries' THEN '50' ELSE value END AS value FROM (VALUES ('name', 'a'), ('num_queries', '200'), ('branch_factor', '64')) t(name, value)")
def record_limit(spark, d):
    """The first records of a collector file, whose metadata then say how many there are."""
    from pagelore.sources import records

    meta = spark.createDataFrame([("name", "a"), ("num_queries", "200"), ("branch_factor", "64")], "name string, value string")
    return results.limited_metadata(meta, records.limited_records(spark.range(200).withColumnRenamed("id", "query_idx"), 50))


def sampled_estimates(probes, ranked_keys, rates, eps, memory, policies=("LFU",), strategy="all_in_once"):
    """(rate, policy, memory, eps, cache_pages, hit_ratio, dac, cost, estimated_total_ios): costs estimated from prefixes
    of the trace, scaled to the whole of it. Every combination has its row, also where the index leaves no page for the
    cache: nothing hits there."""
    n, q, out = ranked_keys.count(), probes.count(), []
    ranks = keys.predecessor(probes, ranked_keys).select("query_idx", "pos")
    for rate in rates:
        take = max(1, int(q * rate / 100))
        c = costs.point_costs(ranks.where(F.col("query_idx") < take).select("pos"), n, eps, memory, policies, strategy, scale=q / take, without_room=True)
        out.append(c.withColumns({"rate": F.lit(float(rate)), "estimated_total_ios": F.col("cost") * q}))
    return report.union_all(out)


@query(
    " UNION ALL ".join(
        "SELECT * FROM (" + RANKS.replace("SELECT coalesce(k.pos, 0) AS pos FROM event_probes q", f"SELECT coalesce(k.pos, 0) AS pos FROM (SELECT * FROM event_probes WHERE query_idx < greatest(1, floor((SELECT count(*) FROM events) * {rate} / 100))) q")
        + _weights("(VALUES (16), (64)) e(eps)") + f""", g AS (SELECT eps, page_id, sum(p) AS refs, max(p >= 1) AS certain, sum(CASE WHEN p < 1 THEN ln(1 - p) ELSE 0 END) AS lm FROM c GROUP BY ALL),
f AS (SELECT (SELECT count(*) FROM events) / (SELECT count(*) FROM ranks) AS scale), s AS (SELECT eps, sum(refs) AS total, sum(CASE WHEN certain THEN 1 ELSE 1 - exp(least(scale * lm, 0)) END) / any_value(scale) AS dist FROM g, f GROUP BY eps),
m AS (SELECT eps, (65536 - (16 * (SELECT count(*) FROM events_keys)) // (2 * eps)) // 4096 AS cap FROM (VALUES (16), (64)) e(eps)), o AS (SELECT eps, refs, row_number() OVER (PARTITION BY eps ORDER BY refs DESC) AS r FROM g),
h AS (SELECT o.eps, sum(refs) FILTER (WHERE r <= cap) / any_value(total) AS h, any_value(1 - dist / total) AS most FROM o JOIN s USING (eps) JOIN m USING (eps) GROUP BY o.eps)
SELECT {rate}::DOUBLE AS rate, eps::INTEGER AS eps, round((1 - least(h, most)) * (1 + 2 * eps / 512), 6) AS cost, round((1 - least(h, most)) * (1 + 2 * eps / 512) * (SELECT count(*) FROM events), 2) AS estimated_total_ios FROM h)""" for rate in (10, 100)
    ),
    "events_keys event_probes",
)
def sampled_estimate_sweep(spark, d):
    e = sampled_estimates(I.event_probes(spark, d), I.events_keys(spark, d), [10, 100], [16, 64], [65_536])
    return e.select("rate", "eps", F.round("cost", 6).alias("cost"), F.round("estimated_total_ios", 2).alias("estimated_total_ios"))


def range_experiment(ranges, ranked_keys, ranks, eps, memory: int, rates, policy: str = "LRU"):
    """Range lookups estimated from prefixes (rank_lo, rank_hi) and replayed whole: each rate's estimate beside the
    replay of its epsilon."""
    from pagelore.operators import access
    from pagelore.operators.predict import Exact

    n, q, out = ranked_keys.count(), ranges.count(), []
    for rate in rates:
        e = costs.range_costs(ranks.where(F.col("query_idx") < max(1, int(q * rate / 100))), n, eps, [memory], (policy,))
        out.append(e.select(F.lit(float(rate)).alias("rate"), F.col("eps").alias("epsilon"), (F.col("cost") * q).alias("estimated_total_ios")))
    actual = []
    for e in eps:
        w = access.range_windows(ranges, Exact(ranked_keys, e)).withColumn("dac", F.col("page_hi") - F.col("page_lo") + 1)
        room = cache.capacity_pages(cache.cache_bytes("ESTIMATED", memory, n, e))
        actual.append(cache.replay_summary(cache.replay(access.page_trace(w), [{"policy": policy, "capacity": room}])).select(F.lit(e).alias("epsilon"), F.col("total_misses").cast("double").alias("actual_total_ios")))
    return report.with_accuracy(report.union_all(out).join(report.union_all(actual), "epsilon"), "actual_total_ios", "estimated_total_ios")


@query()
def range_sampling_comparison(spark, d):
    ranks, _ = range_ranks(spark, d)
    return range_experiment(I.event_ranges(spark, d), I.events_keys(spark, d), ranks, [16, 64], 49_152, [10, 100])


def range_calibration(ranked_keys, spans, repeats: int, ipp: int = 512):
    """(range_pages, repeat, IOs, records, total_wall_time_s): ranges of so many pages, each repeat elsewhere, fetched
    with nothing cached. Wall times differ from run to run."""
    import time

    from pagelore.operators.access import range_records

    pages = -(-ranked_keys.count() // ipp)
    spark, rows = ranked_keys.sparkSession, []
    for span in spans:
        for k in range(repeats):
            first = (k * 7919) % max(1, pages - span + 1)
            ends = ranked_keys.where(F.col("page_id").between(first, first + span - 1)).agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
            at = time.perf_counter()
            r = range_records(ends.select(F.lit(0).cast("bigint").alias("query_idx"), "lo", "hi"), ranked_keys).agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("p")).first()
            rows.append((span, k, r.p, r.n, time.perf_counter() - at))
    return spark.createDataFrame(rows, "range_pages bigint, repeat int, IOs bigint, records bigint, total_wall_time_s double")


@query("WITH p AS (SELECT pos // 512 AS page_id, count(*) AS n FROM events_keys GROUP BY 1), c AS (SELECT count(*) AS pages FROM p), r AS (SELECT s AS range_pages, k AS repeat, k * 7919 % greatest(1, pages - s + 1) AS first FROM (VALUES (1), (2), (4)) s(s), range(3) k(k), c) SELECT range_pages::BIGINT AS range_pages, repeat::INTEGER AS repeat, count(*) AS IOs, sum(n)::BIGINT AS records FROM r JOIN p ON page_id BETWEEN first AND first + range_pages - 1 GROUP BY ALL", "events_keys")
def range_calibration_sizes(spark, d):
    return range_calibration(I.events_keys(spark, d), [1, 2, 4], 3).drop("total_wall_time_s")


@query(
    f"""WITH {RUNS}, e AS (SELECT eps AS epsilon, upper(pol) AS policy, sum(misses) * 0.9 / sum(q) AS ios FROM runs GROUP BY ALL), s AS (SELECT eps AS epsilon, upper(pol) AS policy, sum(misses) / sum(q) AS ios FROM runs WHERE eps <> 8 GROUP BY ALL)
SELECT epsilon, policy, round(e.ios, 6) AS ios, round(s.ios, 6) AS sim_ios, round(abs(e.ios - s.ios), 6) AS abs_ios, round(abs(e.ios - s.ios) / s.ios, 6) AS rel_ios FROM e JOIN s USING (epsilon, policy)"""
)
def state_space_comparison(spark, d):
    """Estimates beside simulations by (epsilon, policy)."""
    r = _runs(spark, d).groupBy(F.col("Epsilon").cast("int").alias("epsilon"), F.upper("Policy").alias("policy")).agg((F.sum("total cache misses") / F.sum("queries")).alias("ios"))
    c = report.state_space_rows(r.withColumn("ios", F.col("ios") * 0.9), r.where("epsilon <> 8"), ["epsilon", "policy"], ["ios"])
    return c.select("epsilon", "policy", *[F.round(x, 6).alias(x) for x in ("ios", "sim_ios", "abs_ios", "rel_ios")])


@query(
    """WITH b AS (SELECT pow(2, 4 + o_orderkey % 6)::BIGINT AS bf, (o_orderkey % 3)::DOUBLE AS M, avg(o_totalprice) AS act, avg(o_totalprice) * 0.9 - pow(2, 4 + o_orderkey % 6) AS est FROM orders GROUP BY 1, 2, o_orderkey % 6)
SELECT bf AS branch_factor, M, round(act, 4) AS act, round(est, 4) AS est FROM b WHERE bf BETWEEN 32 AND 256"""
)
def rmi_residual_frame(spark, d):
    """Rows of branching factors in a range, measured and estimated, as the residual model takes them."""
    o = table(spark, d, "orders").select(F.pow(F.lit(2), 4 + F.col("o_orderkey") % 6).cast("bigint").alias("branch_factor"), (F.col("o_orderkey") % 3).cast("double").alias("M"), "o_totalprice")
    g = o.groupBy("branch_factor", "M").agg(F.avg("o_totalprice").alias("act"))
    g = g.withColumn("est", F.col("act") * 0.9 - F.col("branch_factor")).where(report.in_range(F.col("branch_factor"), 32, 256))
    return g.select("branch_factor", "M", F.round("act", 4).alias("act"), F.round("est", 4).alias("est"))


@query("SELECT 4::BIGINT AS terms, 0.0::DOUBLE AS mae_after")
def rmi_residual_run(spark, d):
    """A residual of the model's own form, k1 bf + k2 / bf + k3 M + k4, is found exactly."""
    o = table(spark, d, "orders").select(F.pow(F.lit(2), 4 + F.col("o_orderkey") % 6).alias("branch_factor"), (F.col("o_orderkey") % 3).cast("double").alias("M"), (F.col("o_custkey") % 100).cast("double").alias("est"))
    o = o.withColumn("act", F.col("est") + 500 + 0.01 * F.col("branch_factor") + 8 / F.col("branch_factor") + 3 * F.col("M"))
    f = tune.rmi_residual_features()
    w = tune.fit_residuals(o, "act", "est", f)
    after = tune.error_summary(tune.correct(o, "est", f, w), "act", "corrected").first()
    return spark.createDataFrame([(len(f), abs(round(after.mae, 4)))], "terms bigint, mae_after double")


@query("SELECT least(query_idx, 4)::BIGINT AS g, count(*) AS n FROM (SELECT event_id % 5 AS query_idx FROM events) GROUP BY 1")
def detail_rows(spark, d):
    """Per-query rows written as a detail CSV and read again."""
    path = f"{shared_dir(spark)}/detail-{uuid.uuid4().hex}"
    rows = table(spark, d, "events").select((F.col("event_id") % 5).alias("g"), "event_id")
    rows.write.csv(path, header=True)
    return spark.read.csv(path, header=True, schema="g bigint, event_id bigint").groupBy("g").agg(F.count("*").alias("n"))
