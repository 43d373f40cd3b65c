"""Queries on reports, sources and whole experiments. Orders stand for the rows of actual runs, events for
estimates: the operators don't care."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pagelore.functions import labels
from pagelore.operators import access, cache, costs, keys, pgm, report
from pagelore.operators.predict import Exact, Pgm
from pagelore.plans import inputs as I
from pagelore.plans.base import query
from pagelore.plans.cost_queries import fold
from pagelore.runtime import shared_dir, table
from pagelore.schema import POLICIES

#: One actual and one estimated row for each (dataset, M, epsilon, policy).
ACTUAL = "actual AS (SELECT 'd' || (o_custkey % 3) AS dataset, (o_orderkey % 4)::INTEGER AS M, (o_orderkey % 8 * 8)::INTEGER AS epsilon, sum(o_totalprice) AS actual_total_ios, count(*) AS queries FROM orders GROUP BY ALL)"
ESTIMATE = "estimate AS (SELECT 'd' || (o_custkey % 3) AS dataset, (o_orderkey % 4)::INTEGER AS M, (o_orderkey % 8 * 8)::INTEGER AS epsilon, sum(o_totalprice) * 0.9 + 1000 AS estimated_total_ios, (sum(o_totalprice) * 0.9 + 1000) / (count(*) + 1) AS estimated_ios, count(*) + 1 AS estimate_queries FROM orders WHERE o_orderkey % 8 < 7 GROUP BY ALL)"


def _runs(spark, d):
    o = table(spark, d, "orders").select(F.concat(F.lit("d"), F.col("o_custkey") % 3).alias("dataset"), (F.col("o_orderkey") % 4).cast("int").alias("M"), (F.col("o_orderkey") % 8 * 8).cast("int").alias("epsilon"), "o_totalprice")
    a = o.groupBy("dataset", "M", "epsilon").agg(F.sum("o_totalprice").alias("actual_total_ios"), F.count("*").alias("queries"))
    e = o.where("epsilon < 56").groupBy("dataset", "M", "epsilon").agg((F.sum("o_totalprice") * 0.9 + 1000).alias("estimated_total_ios"), (F.count("*") + 1).alias("estimate_queries"))
    return a, e.withColumn("estimated_ios", F.col("estimated_total_ios") / F.col("estimate_queries"))


@query(
    f"""WITH {ACTUAL}, {ESTIMATE}, m AS (SELECT a.*, e.estimate_queries, e.estimated_ios * a.queries AS est FROM actual a JOIN estimate e USING (dataset, M, epsilon) WHERE epsilon >= 8),
x AS (SELECT *, abs(est - actual_total_ios) / actual_total_ios AS rel FROM m)
SELECT dataset, M, round(avg(least(greatest(1 - rel, 0), 1)), 6) AS mean_accuracy, round(avg(rel), 6) AS mean_relative_error, count(*) AS epsilon_points, round(avg(actual_total_ios), 1) AS mean_actual_total_ios,
       round(avg(est), 1) AS mean_estimated_total_ios, avg(queries - estimate_queries) AS mean_query_count_delta, max(queries) AS actual_queries, max(estimate_queries) AS estimate_queries FROM x GROUP BY dataset, M"""
)
def accuracy_summary(spark, d):
    a, e = _runs(spark, d)
    s = report.accuracy_summary(a, e, ["dataset", "M", "epsilon"], ["dataset", "M"], list(range(8, 64, 8)))
    return s.select("dataset", "M", *[F.round(c, n).alias(c) for c, n in (("mean_accuracy", 6), ("mean_relative_error", 6), ("mean_actual_total_ios", 1), ("mean_estimated_total_ios", 1))], "epsilon_points", "mean_query_count_delta", "actual_queries", "estimate_queries")


METHODS = "methods AS (SELECT M, epsilon, CASE k WHEN 0 THEN 'REPLAY' WHEN 1 THEN 'REPLAY' WHEN 2 THEN 'MODEL' ELSE 'LPM' END AS method, (CASE k WHEN 0 THEN 100 WHEN 1 THEN 10 WHEN 2 THEN 10 ELSE 100 END)::DOUBLE AS rate, sum(o_totalprice) * (1 + 0.05 * k) AS ios, count(*) * 0.5 AS setup_s FROM (SELECT (o_orderkey % 4)::INTEGER AS M, (o_orderkey % 8 * 8)::INTEGER AS epsilon, o_totalprice FROM orders), range(4) t(k) GROUP BY M, epsilon, k)"


@query(
    f"""WITH {METHODS}, t AS (SELECT M, epsilon, ios AS truth FROM methods WHERE method = 'REPLAY' AND rate = 100), x AS (SELECT m.*, abs(ios - truth) / truth AS rel, greatest(ios / truth, truth / ios) AS q FROM methods m LEFT JOIN t USING (M, epsilon))
SELECT method, rate, count(*) AS rows, round(avg(rel), 6) AS mean_relative_error, round(avg(q), 6) AS mean_q_error, round(max(q), 6) AS max_q_error, CASE WHEN method = 'MODEL' THEN max(setup_s) ELSE sum(setup_s) END::DOUBLE AS setup_s FROM x GROUP BY method, rate"""
)
def sampling_comparison(spark, d):
    o = table(spark, d, "orders").select((F.col("o_orderkey") % 4).cast("int").alias("M"), (F.col("o_orderkey") % 8 * 8).cast("int").alias("epsilon"), "o_totalprice")
    g = o.groupBy("M", "epsilon").agg(F.sum("o_totalprice").alias("s"), F.count("*").alias("n"))
    kinds = [("REPLAY", 100.0), ("REPLAY", 10.0), ("MODEL", 10.0), ("LPM", 100.0)]
    m = report.union_all([g.select("M", "epsilon", F.lit(k).alias("method"), F.lit(r).alias("rate"), (F.col("s") * (1 + 0.05 * i)).alias("ios"), (F.col("n") * 0.5).alias("setup_s")) for i, (k, r) in enumerate(kinds)])
    return report.sampling_comparison(m, ["M", "epsilon"]).select("method", "rate", "rows", *[F.round(c, 6).alias(c) for c in ("mean_relative_error", "mean_q_error", "max_q_error")], "setup_s")


@query(
    "SELECT l_shipmode_ AS flag, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, min(v) AS min, max(v) AS max, quantile_disc(v, 0.5) AS p50, quantile_disc(v, 0.9) AS p90, quantile_disc(v, 0.95) AS p95, quantile_disc(v, 0.99) AS p99 FROM (SELECT l_returnflag AS l_shipmode_, l_extendedprice AS v FROM lineitem) GROUP BY 1"
)
def io_size_percentiles(spark, d):
    p = report.percentiles(table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("v")), "v", by=["flag"])
    return p.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query("WITH c AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_suppkey, l_returnflag AS flag FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_returnflag) AS r FROM c) WHERE r = 1")
def mode_by_group(spark, d):
    return report.mode_of(table(spark, d, "lineitem").select("l_suppkey", F.col("l_returnflag").alias("flag")), ["l_suppkey"], "flag")


@query(
    """SELECT l_suppkey, count(*) AS repeats, round(avg(l_quantity), 6) AS q_mean, round(stddev_pop(l_quantity), 6) AS q_std, CASE WHEN count(DISTINCT l_linestatus) = 1 THEN min(l_linestatus) ELSE 'varies' END AS status FROM lineitem GROUP BY l_suppkey"""
)
def repeat_aggregates(spark, d):
    r = report.aggregate_repeats(table(spark, d, "lineitem").select("l_suppkey", F.col("l_quantity").alias("q"), F.col("l_linestatus").alias("status")), ["l_suppkey"])
    return r.withColumns({"q_mean": F.round("q_mean", 6), "q_std": F.round("q_std", 6)})


@query("SELECT c_mktsegment, round(avg(c_acctbal), 6) AS c_acctbal, arg_min(c_name, c_custkey) AS c_name, count(DISTINCT c_custkey) AS repeats FROM customer GROUP BY c_mktsegment")
def average_repeats(spark, d):
    r = report.average_repeats(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), ["c_mktsegment"], "c_custkey")
    return r.withColumn("c_acctbal", F.round("c_acctbal", 6))


@query("SELECT n.n_regionkey AS M, count(*) FILTER (WHERE c.k IS NOT NULL AND s.k IS NOT NULL) AS both, count(*) FILTER (WHERE s.k IS NULL) AS left_only, count(*) FILTER (WHERE c.k IS NULL) AS right_only FROM (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_nationkey < 20) c FULL JOIN (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_nationkey > 3) s ON c.k = s.k JOIN nation n ON n.n_nationkey = coalesce(c.k, s.k) GROUP BY 1")
def merge_diagnostics(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("M"))
    c = table(spark, d, "customer").where("c_nationkey < 20").select(F.col("c_nationkey").alias("k")).join(n, "k")
    s = table(spark, d, "supplier").where("s_nationkey > 3").select(F.col("s_nationkey").alias("k")).join(n, "k")
    return report.merge_diagnostics(c, s, ["k", "M"])


@query("SELECT k::INTEGER AS size, b AS brand FROM range(1, 60) t(k), (SELECT 'Brand#' || i AS b FROM range(1, 30) r(i)) EXCEPT SELECT p_size, p_brand FROM part")
def missing_combinations(spark, d):
    p = table(spark, d, "part").select(F.col("p_size").alias("size"), F.col("p_brand").alias("brand"))
    return report.missing_combinations(p, {"size": list(range(1, 60)), "brand": [f"Brand#{i}" for i in range(1, 30)]})


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey")
def latest_rows(spark, d):
    """Later frames replace earlier ones: one frame per order of a customer is its extreme."""
    from pyspark.sql import Window

    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderkey"))
    o = o.withColumn("r", F.row_number().over(w)).where("r <= 2")
    return report.latest([o.where("r = 2").drop("r"), o.where("r = 1").drop("r")], ["o_custkey"])


@query("SELECT l_linenumber, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 9) AS fraction FROM lineitem GROUP BY l_linenumber")
def value_fractions(spark, d):
    return report.fractions(table(spark, d, "lineitem"), "l_linenumber").select("l_linenumber", "count", F.round("fraction", 9).alias("fraction"))


@query("SELECT p_partkey, regexp_extract(p_name || '_' || p_size, '_(\\d+)$', 1)::BIGINT AS bf, CASE WHEN lower(p_brand) LIKE 'books%' THEN 'books' ELSE p_brand END AS label, regexp_replace('table' || p_size, '^table(\\d+)$', 'w\\1') AS workload FROM part")
def label_scalars(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", labels.branch_factor(F.concat("p_name", F.lit("_"), "p_size")).alias("bf"), labels.dataset_label(F.col("p_brand")).alias("label"), labels.workload_label(F.concat(F.lit("table"), "p_size")).alias("workload"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_extendedprice - l_tax - l_discount AS other FROM lineitem")
def latency_parts(spark, d):
    """The residual of a wall value that parts explain."""
    l_ = table(spark, d, "lineitem")
    return report.latency_parts(l_, ["l_tax", "l_discount"], "l_extendedprice").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", (F.col("l_extendedprice") - F.col("l_tax") - F.col("l_discount")).alias("other"))


@query("SELECT pos AS query_idx, key FROM events_keys", "events_keys")
def keyfile_round_trip(spark, d):
    """Keys written as a binary key file to the shared folder and read back whole, by byte ranges."""
    from pagelore.sources import keyfile

    keyfile.register(spark)
    path = f"{shared_dir(spark)}/keyfile-{uuid.uuid4().hex}"
    k = I.events_keys(spark, d)
    k.repartitionByRange(4, "pos").sortWithinPartitions("pos").select("key").write.format("keyfile").mode("append").save(path)
    return spark.read.format("keyfile").options(header="no", split=8192).load(path)


@query()
def point_bench(spark, d):
    """Lookups replayed for each strategy, policy and epsilon under one memory budget."""
    return bench(spark, d, [16, 64], [49_152])


def bench(spark, d, eps, memory, budget_mode="ESTIMATED"):
    k, p = I.events_keys(spark, d), I.event_probes(spark, d)
    n, out = k.count(), []
    for e in eps:
        for s in ("all_in_once", "one_by_one"):
            looked = access.point_lookup(p, k, Exact(k, e), s)
            for m in memory:
                room = cache.capacity_pages(cache.cache_bytes(budget_mode, m, n, e))
                cfg = [{"policy": x, "capacity": room, "put_mode": "deferred"} for x in POLICIES]
                r = cache.replay_summary(cache.replay(access.page_trace(looked), cfg))
                out.append(r.withColumns({"epsilon": F.lit(e), "strategy": F.lit(s), "memory_budget_bytes": F.lit(m), "budget_mode": F.lit(budget_mode)}))
    return report.union_all(out)


#: Segments as in SEGMENTS, with the steepest line of each. A recursion looks ahead of a segment's start as far as its
#: width, which doubles until a point is found that no line reaches. Keys are segmented in chunks, as pgm.level does.
INDEX = f"""WITH RECURSIVE n AS (SELECT count(*)::BIGINT AS n, min(key) AS first_key FROM events_keys),
pt AS MATERIALIZED (SELECT key, pos, pos // {pgm.CHUNK} AS chunk FROM events_keys UNION ALL SELECT max(key) + 1, count(*), (count(*) - 1) // {pgm.CHUNK} FROM events_keys),
ch AS MATERIALIZED (SELECT chunk, min(pos) AS first, max(pos) + 1 AS behind FROM pt GROUP BY chunk),
seg(chunk, first, width, behind) AS (SELECT chunk, first, 4096, behind FROM ch UNION ALL
  SELECT chunk, coalesce(stop, first), CASE WHEN stop IS NULL THEN 2 * width ELSE 4096 END, behind FROM (
    SELECT chunk, first, width, behind, min(pos) FILTER (WHERE lo > hi) AS stop FROM (
      SELECT chunk, first, width, behind, pos, max(lo) OVER w AS lo, min(hi) OVER w AS hi FROM (
        SELECT p.chunk, p.first, p.width, p.behind, b.pos, max((b.pos - p.pos - 128) / (b.key - p.key)) AS lo, min((b.pos - p.pos + 128) / (b.key - p.key)) AS hi
        FROM (SELECT seg.*, a.key, a.pos, unnest(range(a.pos + 1, least(seg.first + seg.width, seg.behind))) AS next FROM seg JOIN pt a ON a.chunk = seg.chunk AND a.pos >= seg.first AND a.pos < seg.first + seg.width) p
        JOIN pt b ON b.pos = p.next GROUP BY ALL) WINDOW w AS (PARTITION BY chunk, first ORDER BY pos)) GROUP BY ALL)
  WHERE stop IS NOT NULL OR first + width < behind),
bound AS (SELECT f.pos AS first, f.key, lead(f.pos, 1, behind) OVER (PARTITION BY f.chunk ORDER BY f.pos) AS stop FROM (SELECT DISTINCT chunk, first, behind FROM seg) s JOIN pt f ON f.pos = s.first),
steep AS (SELECT p.first, arg_min({{'rise': b.pos - p.pos + 128, 'run': b.key - p.key, 'x': p.key, 'y': p.pos - 64}}, (b.pos - p.pos + 128) / (b.key - p.key)) AS s
  FROM (SELECT bound.first, a.key, a.pos, unnest(range(a.pos + 1, bound.stop)) AS next FROM bound JOIN pt a ON a.pos >= bound.first AND a.pos < bound.stop) p JOIN pt b ON b.pos = p.next GROUP BY p.first),
line AS (SELECT key, coalesce((s.rise::DOUBLE / s.run)::FLOAT::DOUBLE, 0) AS slope, coalesce(s.y - ((s.rise::HUGEINT * (s.x - key) + s.run // 2) // s.run)::BIGINT, first) AS intercept FROM bound LEFT JOIN steep USING (first)),
segments AS (SELECT *, lead(intercept, 1, n) OVER (ORDER BY key) AS next_intercept FROM line, n)"""


def _range_bench_sql():
    trace = """, e AS (SELECT query_idx, greatest(lo, first_key) AS key FROM event_ranges, n UNION ALL SELECT query_idx, greatest(hi, first_key) FROM event_ranges, n),
r AS (SELECT e.query_idx, greatest(least(floor(s.slope * (e.key - s.key)::DOUBLE)::BIGINT + s.intercept, s.next_intercept), 0) AS pos FROM e ASOF JOIN segments s ON e.key >= s.key),
w AS (SELECT query_idx, min(greatest(pos - 64, 0) // 512) AS a, max((least(pos + 66, n) - 1) // 512) AS b FROM r, n GROUP BY query_idx),
t0 AS (SELECT query_idx, unnest(range(a, b + 1)) AS page_id, generate_subscripts(range(a, b + 1), 1) - 1 AS seq FROM w), t AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY query_idx, seq) AS i FROM t0) """
    return INDEX + trace + " UNION ALL ".join(f"SELECT * FROM (WITH {fold(p, 8).removeprefix(', ')} SELECT '{p}' AS policy, (SELECT count(DISTINCT query_idx) FROM t) AS queries, count(*) AS total_dac, count(*) FILTER (WHERE hit) AS total_hits FROM hits)" for p in ("FIFO", "LRU", "LFU"))


@query(_range_bench_sql(), "events_keys event_ranges")
def range_bench(spark, d):
    """Range lookups by the segments of an index built over the keys, replayed for each policy."""
    k, r = I.events_keys(spark, d), I.event_ranges(spark, d)
    w = access.range_windows(r, Pgm(k, pgm.build(k, 64), 64)).withColumn("dac", F.col("page_hi") - F.col("page_lo") + 1)
    r = cache.replay_totals(w, [{"policy": x, "capacity": 8} for x in POLICIES])
    return r.select("policy", "queries", "total_dac", "total_hits")


@query()
def estimate_against_replay(spark, d):
    """The experiment end to end: costs estimated from a 30 % prefix, held against the replay of the whole."""
    from pagelore.operators.workload import learning_prefix

    k, p = I.events_keys(spark, d), I.event_probes(spark, d)
    n, q, m, eps = k.count(), p.count(), 49_152, [16, 64]
    prefix = keys.predecessor(learning_prefix(p, 0.3), k).select("pos")
    e = costs.point_costs(prefix, n, eps, [m], ("FIFO", "LRU", "LFU"), scale=q / max(1, prefix.count()))
    est = e.select("policy", F.col("eps").alias("epsilon"), F.lit(q).alias("estimate_queries"), F.col("cost").alias("estimated_ios"), (F.col("cost") * q).alias("estimated_total_ios"))
    act = bench(spark, d, eps, [m]).where("strategy = 'all_in_once'").select("policy", "epsilon", F.col("total_misses").cast("double").alias("actual_total_ios"), "queries")
    return report.accuracy_summary(act, est, ["policy", "epsilon"], ["policy"])
