"""Queries on learned indexes, join costs, workloads and tuners."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelore.operators import access, cache, costs, join_cost, keys, pgm, rmi, tune, workload
from pagelore.operators.predict import Leaves, Pgm
from pagelore.plans import inputs as I
from pagelore.plans.base import query
from pagelore.plans.cost_queries import RANKS, _weights
from pagelore.runtime import table
from pagelore.schema import ITEMS_PER_PAGE

EPS = 32


@query()
def pgm_segments(spark, d):
    return pgm.build(I.events_keys(spark, d), EPS)


@query()
def pgm_index_sizes(spark, d):
    return pgm.index_sizes(I.events_keys(spark, d), [8, 16, 32, 64, 128])


#: A segment ends before the first point at which the steepest line that some pair of its points allows is flatter than
#: the flattest that another demands; the point behind the last key counts too.
SEGMENTS = """WITH RECURSIVE ks AS (SELECT key, (row_number() OVER (ORDER BY key) - 1)::BIGINT AS pos FROM (SELECT DISTINCT round(c_acctbal * 100)::BIGINT AS key FROM customer)),
pt AS (SELECT key, pos FROM ks UNION ALL SELECT max(key) + 1, count(*) FROM ks),
seg(eps, first) AS (SELECT eps, 0::BIGINT FROM (VALUES (4), (16), (64)) t(eps) UNION ALL
  SELECT seg.eps, nx.stop FROM seg, LATERAL (SELECT min(pos) AS stop FROM (SELECT pos, max(lo) OVER (ORDER BY pos) AS lo, min(hi) OVER (ORDER BY pos) AS hi FROM (
    SELECT b.pos, max((b.pos - a.pos - 2 * seg.eps) / (b.key - a.key)) AS lo, min((b.pos - a.pos + 2 * seg.eps) / (b.key - a.key)) AS hi FROM pt a JOIN pt b ON a.pos < b.pos WHERE a.pos >= seg.first GROUP BY b.pos)) WHERE lo > hi) nx WHERE nx.stop IS NOT NULL)"""


@query(SEGMENTS + " SELECT eps, (row_number() OVER (PARTITION BY eps ORDER BY first) - 1)::BIGINT AS seg_id, pt.key, (lead(first, 1, (SELECT count(*) FROM pt)) OVER (PARTITION BY eps ORDER BY first) - first)::BIGINT AS points FROM seg JOIN pt ON pt.pos = first")
def pgm_segment_bounds(spark, d):
    """First key and number of points of each segment of the customers' balances, for three error bounds."""
    k = keys.ranked(table(spark, d, "customer").select(F.round(F.col("c_acctbal") * 100).cast("bigint").alias("key")))
    return pgm.level(k, [4, 16, 64]).select("eps", "seg_id", "key", "points")


@query(
    SEGMENTS + """, k0 AS (SELECT eps, pt.key, (row_number() OVER (PARTITION BY eps ORDER BY first) - 1)::BIGINT AS pos FROM seg JOIN pt ON pt.pos = first),
p1 AS (SELECT eps, key, pos FROM k0 UNION ALL SELECT eps, max(key) + 1, count(*) FROM k0 GROUP BY eps),
seg1(eps, first) AS (SELECT eps, 0::BIGINT FROM (SELECT eps FROM k0 GROUP BY eps HAVING count(*) > 1) UNION ALL
  SELECT seg1.eps, nx.stop FROM seg1, LATERAL (SELECT min(pos) AS stop FROM (SELECT pos, max(lo) OVER (ORDER BY pos) AS lo, min(hi) OVER (ORDER BY pos) AS hi FROM (
    SELECT b.pos, max((b.pos - a.pos - 8) / (b.key - a.key)) AS lo, min((b.pos - a.pos + 8) / (b.key - a.key)) AS hi FROM p1 a JOIN p1 b ON a.eps = b.eps AND a.pos < b.pos WHERE a.eps = seg1.eps AND a.pos >= seg1.first GROUP BY b.pos)) WHERE lo > hi) nx WHERE nx.stop IS NOT NULL),
c AS (SELECT eps, (SELECT count(*) FROM k0 WHERE k0.eps = e.eps) AS n0, (SELECT count(*) FROM seg1 WHERE seg1.eps = e.eps) AS n1 FROM (VALUES (4), (16), (64)) e(eps))
SELECT eps::INTEGER AS epsilon, n0 AS segments, (16 * (n0 + n1 + (n1 > 1)::INTEGER) + 8 * (1 + (n1 > 0)::INTEGER + (n1 > 1)::INTEGER))::BIGINT AS measured_index_bytes FROM c"""
)
def pgm_index_sizes_small(spark, d):
    """Bytes of all levels, the upper ones with an error bound of 4."""
    k = keys.ranked(table(spark, d, "customer").select(F.round(F.col("c_acctbal") * 100).cast("bigint").alias("key")))
    return pgm.index_sizes(k, [4, 16, 64])


@query()
def pgm_size(spark, d):
    return pgm.sizes(pgm.build(I.events_keys(spark, d), EPS))


@query("SELECT q.query_idx, q.key, k.key IS NOT NULL AS found, true AS covered FROM event_probes q LEFT JOIN events_keys k ON q.key = k.key", "events_keys event_probes")
def pgm_point_lookup(spark, d):
    """Lookups by segments; covered: the window holds the page of every key that is there."""
    k = I.events_keys(spark, d)
    w = access.point_lookup(I.event_probes(spark, d), k, Pgm(k, pgm.build(k, EPS), EPS))
    w = w.join(k.select("key", "page_id"), "key", "left")
    return w.select("query_idx", "key", "found", (~F.col("found") | F.col("page_id").between(F.col("page_lo"), F.col("page_hi"))).alias("covered"))


@query("SELECT r.query_idx, count(*) AS matched, true AS covered FROM event_ranges r JOIN events_keys k ON k.key BETWEEN r.lo AND r.hi GROUP BY r.query_idx", "events_keys event_ranges")
def pgm_range_lookup(spark, d):
    """covered: the range's page window holds the pages of all its keys."""
    k = I.events_keys(spark, d)
    r = I.event_ranges(spark, d)
    w = access.range_windows(r, Pgm(k, pgm.build(k, EPS), EPS)).select("query_idx", "page_lo", "page_hi")
    found = access.range_records(r, k).groupBy("query_idx").agg(F.count("*").alias("matched"), F.min("page_id").alias("a"), F.max("page_id").alias("b"))
    return found.join(w, "query_idx").select("query_idx", "matched", ((F.col("a") >= F.col("page_lo")) & (F.col("b") <= F.col("page_hi"))).alias("covered"))


BF = 32
#: A two-layer model of end-point lines, as SQL: top over scaled ranks, one line per leaf with its neighbours' border points.
RMI = f"""WITH n AS (SELECT count(*) AS n, min(key)::DOUBLE AS x0, max(key)::DOUBLE AS x1, (count(*) - 1) * ({BF} / count(*)) AS y1 FROM events_keys),
routed AS (SELECT key, pos, least(greatest(floor(y1 / (x1 - x0) * (key::DOUBLE - x0)), 0), {BF - 1})::INTEGER AS leaf_id FROM events_keys, n),
ends AS (SELECT leaf_id, min(key) AS fk, max(key) AS lk, min(pos) AS fp, max(pos) AS lp FROM routed GROUP BY leaf_id),
nb AS (SELECT *, lag(lk) OVER w AS pk, lag(lp) OVER w AS pp, lead(fk) OVER w AS nk, lead(fp) OVER w AS np FROM ends WINDOW w AS (ORDER BY leaf_id)),
pts AS (SELECT leaf_id, key, pos FROM routed UNION ALL SELECT leaf_id, pk, pp FROM nb WHERE pk IS NOT NULL UNION ALL SELECT leaf_id, nk, np FROM nb WHERE nk IS NOT NULL),
line AS (SELECT leaf_id, coalesce((max(pos::DOUBLE) - min(pos::DOUBLE)) / nullif(max(key::DOUBLE) - min(key::DOUBLE), 0), 0) AS a, min(key::DOUBLE) AS x0, min(pos::DOUBLE) AS y0 FROM pts GROUP BY leaf_id),
p AS (SELECT l.*, n.n FROM line l, n),
own AS (SELECT r.leaf_id, max(abs(least(greatest(floor(y0 + a * (key::DOUBLE - x0)), 0), n - 1)::BIGINT - pos)) AS e FROM routed r JOIN p USING (leaf_id) GROUP BY r.leaf_id),
leaves AS (SELECT p.leaf_id, p.a, p.x0, p.y0, p.n, greatest(e, coalesce(abs(least(greatest(floor(y0 + a * ((nk - 1)::DOUBLE - x0)), 0), n - 1)::BIGINT - np), 0), coalesce(abs(least(greatest(floor(y0 + a * ((pk + 1)::DOUBLE - x0)), 0), n - 1)::BIGINT - pp), 0)) AS err
           FROM p JOIN own USING (leaf_id) JOIN nb USING (leaf_id)),
probed AS (SELECT query_idx, key, least(greatest(floor(n.y1 / (n.x1 - n.x0) * (key::DOUBLE - n.x0)), 0), {BF - 1})::INTEGER AS leaf_id FROM event_probes, n),
recs AS (SELECT q.query_idx, q.key, q.leaf_id, coalesce(l.err, 0) AS err, coalesce(least(greatest(floor(l.y0 + l.a * (q.key::DOUBLE - l.x0)), 0), l.n - 1)::BIGINT, 0) AS pred_pos FROM probed q LEFT JOIN leaves l USING (leaf_id))"""


def _rmi(spark, d):
    k = I.events_keys(spark, d)
    return k, rmi.train(k, "linear_spline", "linear_spline", BF)


def _records(spark, d):
    k, m = _rmi(spark, d)
    return k, rmi.collect_records(m, I.event_probes(spark, d), k, max_err=1.0, max_share=1.0)


@query(RMI + " SELECT leaf_id, err FROM leaves", "events_keys event_probes")
def rmi_leaves(spark, d):
    return _rmi(spark, d)[1].leaves.select("leaf_id", "err")


@query(RMI + " SELECT query_idx, key, leaf_id, err, pred_pos FROM recs", "events_keys event_probes")
def rmi_records(spark, d):
    return _records(spark, d)[1].select("query_idx", "key", "leaf_id", "err", "pred_pos")


@query(
    RMI + ", w AS (SELECT query_idx, least(greatest(pred_pos - err, 0) // 512, (n - 1) // 512) AS lo, least(pred_pos + err, n - 1) // 512 AS hi FROM recs, (SELECT n FROM n)) SELECT query_idx, lo AS page_lo, greatest(lo, hi) AS page_hi FROM w",
    "events_keys event_probes",
)
def rmi_page_windows(spark, d):
    k, m = _rmi(spark, d)
    return Leaves(m, k.count()).windows(I.event_probes(spark, d)).select("query_idx", "page_lo", "page_hi")


@query(RMI + ", s AS (SELECT leaf_id, count(*) AS queries, max(err) AS eps FROM recs GROUP BY leaf_id) SELECT leaf_id, queries, eps, round(queries / (SELECT count(*) FROM recs), 9) AS weight FROM s", "events_keys event_probes")
def rmi_leaf_stats(spark, d):
    return costs.leaf_stats(_records(spark, d)[1]).select("leaf_id", "queries", "eps", F.round("weight", 9).alias("weight"))


@query(
    RMI + """, s AS (SELECT count(*) / (SELECT count(*) FROM recs) AS w, max(err) AS e FROM recs GROUP BY leaf_id)
SELECT round(sum(w * (1 + 2 * e / 512)), 6) AS all_in_once, round(sum(w * (1 + e / 512)), 6) AS one_by_one, round(sum(w * (1 + 2 * least(e, 100) / 512)), 6) AS capped,
       round(sum(w * (1 + 2 * (512 * ln(1 + e / 512)) / 512)), 6) AS logcap, round(sum(w * (1 + 2 * sqrt(e) / 512)), 6) AS power FROM s""",
    "events_keys event_probes",
)
def rmi_edac(spark, d):
    s = costs.leaf_stats(_records(spark, d)[1])
    forms = {"all_in_once": {}, "one_by_one": {"strategy": "one_by_one"}, "capped": {"kind": "cap", "at": 100.0}, "logcap": {"kind": "logcap"}, "power": {"kind": "power"}}
    row = [round(costs.rmi_edac(s, **kw).first().edac, 6) for kw in forms.values()]
    return spark.createDataFrame([tuple(row)], ", ".join(f"{c} double" for c in forms))


@query(RMI + ", c AS (SELECT err, count(*) AS n FROM recs GROUP BY err), r AS (SELECT err, sum(n) OVER (ORDER BY err) / sum(n) OVER () AS cdf FROM c) SELECT min(err) AS value FROM r WHERE cdf >= 0.9", "events_keys event_probes")
def rmi_eps_cap(spark, d):
    """The weighted 90 % quantile of errors."""
    return costs.weighted_quantile(_records(spark, d)[1].select("err", F.lit(1).alias("w")), "err", "w", 0.9)


@query(RMI + " SELECT err, count(*) AS count, round(count(*) / (SELECT count(*) FROM leaves), 9) AS fraction FROM leaves GROUP BY err", "events_keys event_probes")
def rmi_error_histogram(spark, d):
    from pagelore.operators.report import fractions

    return fractions(_rmi(spark, d)[1].leaves.select("err"), "err").select("err", "count", F.round("fraction", 9).alias("fraction"))


#: Expected requests of each page, every lookup with its leaf's error; then the LRU time of eight pages by bisection.
RMI_PAGES = RMI + """, tp AS (SELECT r.*, coalesce(k.pos, 0) AS pos FROM recs r ASOF LEFT JOIN events_keys k ON r.key >= k.key),
x AS (SELECT query_idx, leaf_id, err AS eps, pos // 512 AS p, pos % 512 AS s, unnest(range(floor(-2 * err / 512)::BIGINT, floor((511 + 2 * err) / 512)::BIGINT + 1)) AS d FROM tp),
pw AS (SELECT query_idx, leaf_id, p + d AS page_id, greatest(0, least(eps, (d + 1) * 512 - 1 - s + eps) - greatest(-eps, d * 512 - s - eps) + 1) / (2 * eps + 1) AS w FROM x),
own_pages AS (SELECT * FROM pw WHERE w > 0 AND page_id >= 0 AND page_id < (SELECT (count(*) + 511) // 512 FROM events_keys)),
pop AS (SELECT page_id, sum(w) AS refs, sum(w) / (SELECT sum(w) FROM own_pages) AS q FROM own_pages GROUP BY page_id),
bis(i, lo, hi) AS (SELECT 0, 0.0::DOUBLE, 1e9::DOUBLE UNION ALL
  SELECT bis.i + 1, CASE WHEN s.v < 8 THEN (bis.lo + bis.hi) / 2 ELSE bis.lo END, CASE WHEN s.v < 8 THEN bis.hi ELSE (bis.lo + bis.hi) / 2 END FROM bis, LATERAL (SELECT sum(1 - exp(-q * (bis.lo + bis.hi) / 2)) AS v FROM pop) s WHERE bis.i < 100),
che AS (SELECT (lo + hi) / 2 AS t FROM bis WHERE i = 100),
st AS (SELECT leaf_id, count(*) / (SELECT count(*) FROM recs) AS w, max(err) AS e FROM recs GROUP BY leaf_id)"""
RMI_PAGES = RMI_PAGES.replace("WITH ", "WITH RECURSIVE ", 1)


@query(RMI_PAGES + ", r AS (SELECT (SELECT sum(q * (1 - exp(-q * t))) FROM pop, che) AS h, (SELECT sum(w * (1 + 2 * e / 512)) FROM st) AS edac) SELECT round(h, 6) AS hit_ratio, round(edac, 6) AS edac, round((1 - h) * edac, 6) AS cost FROM r", "events_keys event_probes")
def rmi_cost(spark, d):
    k, r = _records(spark, d)
    h, e, c = costs.rmi_cost(r, -(-k.count() // ITEMS_PER_PAGE), 8)
    return spark.createDataFrame([(round(h, 6), round(e, 6), round(c, 6))], "hit_ratio double, edac double, cost double")


@query(
    RMI_PAGES + """, lh AS (SELECT o.leaf_id, sum(o.w * (1 - exp(-q * t))) / sum(o.w) AS h FROM own_pages o JOIN pop USING (page_id), che GROUP BY o.leaf_id)
SELECT leaf_id, round(w, 6) AS weight, round(1 + 2 * e / 512, 6) AS edac, round(h, 6) AS hit_ratio, round(w * (1 - h) * (1 + 2 * e / 512), 6) AS cost FROM st JOIN lh USING (leaf_id)""",
    "events_keys event_probes",
)
def rmi_cost_leafwise(spark, d):
    k, r = _records(spark, d)
    c = costs.rmi_cost_leafwise(r, -(-k.count() // ITEMS_PER_PAGE), 8)
    return c.select("leaf_id", *[F.round(x, 6).alias(x) for x in ("weight", "edac", "hit_ratio", "cost")])


def _with_top(top_sql, extra=""):
    """RMI with another rule that routes keys: an expression over key and n, after further relations."""
    routed = "routed AS (SELECT key, pos, least(greatest(floor(y1 / (x1 - x0) * (key::DOUBLE - x0)), 0), 31)::INTEGER AS leaf_id FROM events_keys, n)"
    assert routed in RMI
    return RMI.split("probed AS")[0].rstrip().rstrip(",").replace(routed, extra + f"routed AS (SELECT k.key, k.pos, least(greatest({top_sql}, 0), 31)::INTEGER AS leaf_id FROM events_keys k, n)")


#: The key's first bits behind the prefix that all keys share.
BITS = "pre AS (SELECT min(key) AS a, 64 - length(ltrim(lpad(bin(xor(min(key), max(key))), 64, '0'), '0')) AS shared FROM events_keys),\n"
TOP_BITS = "((k.key - (SELECT (a >> (64 - shared)) << (64 - shared) FROM pre)) >> (SELECT greatest(0, 64 - shared - {bits}) FROM pre))"


@query(_with_top(TOP_BITS.format(bits=5), BITS) + " SELECT leaf_id, err FROM leaves", "events_keys")
def rmi_radix_leaves(spark, d):
    return rmi.train(I.events_keys(spark, d), "radix", "linear_spline", BF).leaves.select("leaf_id", "err")


@query(
    _with_top("(SELECT v FROM slots WHERE slots.s = " + TOP_BITS.format(bits=18) + ")", BITS + "slots AS (SELECT " + TOP_BITS.format(bits=18) + f" AS s, min(pos * ({BF} / n.n)) AS v FROM events_keys k, n GROUP BY 1),\n").replace("least(greatest((SELECT", "least(greatest(floor((SELECT").replace("), 0), 31)::INTEGER AS leaf_id FROM events_keys k", ")), 0), 31)::INTEGER AS leaf_id FROM events_keys k")
    + " SELECT leaf_id, err FROM leaves",
    "events_keys",
)
def rmi_radix_table_leaves(spark, d):
    """A hint table of 18 bits."""
    return rmi.train(I.events_keys(spark, d), "radix18", "linear_spline", BF).leaves.select("leaf_id", "err")


@query(_with_top(f"least(k.pos // (n.n // {BF - 1}), {BF - 2})") + " SELECT leaf_id, err FROM leaves", "events_keys")
def rmi_histogram_leaves(spark, d):
    """Equi-depth bins."""
    return rmi.train(I.events_keys(spark, d), "histogram", "linear_spline", BF).leaves.select("leaf_id", "err")


@query()
def rmi_cubic_leaves(spark, d):
    return rmi.train(I.price_keys(spark, d), "linear", "cubic", 64).leaves


@query()
def rmi_models(spark, d):
    """Error statistics of every top model."""
    k = I.price_keys(spark, d)
    out = []
    for top in rmi.TOP_ONLY + rmi.ANYWHERE:
        m = rmi.train(k, top, "linear", 64)
        s = rmi.error_stats(m, k).first()
        out.append((top, float(s.avg_error), float(s.avg_log2), int(s.max_error)))
    return spark.createDataFrame(out, "top string, avg_error double, avg_log2 double, max_error bigint")


CONFIGS = "configs AS (SELECT l_suppkey AS id, (sum(l_partkey) % 1000)::BIGINT AS size, (sum(l_quantity)::BIGINT % 997)::DOUBLE AS avg_log2 FROM lineitem GROUP BY l_suppkey)"


@query(f"WITH {CONFIGS} SELECT id, size, avg_log2 FROM configs c WHERE NOT EXISTS (SELECT 1 FROM configs o WHERE (o.size <= c.size AND o.avg_log2 < c.avg_log2) OR (o.size < c.size AND o.avg_log2 <= c.avg_log2))")
def pareto_front(spark, d):
    return rmi.pareto_front(_configs(spark, d))


def _configs(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg((F.sum("l_partkey") % 1000).alias("size"), (F.sum("l_quantity").cast("bigint") % 997).cast("double").alias("avg_log2"))


@query(
    f"WITH {CONFIGS}, x AS (SELECT *, (1200 * ratio)::DOUBLE AS cb FROM configs, (VALUES (0.25), (0.5), (0.75)) r(ratio)), r AS (SELECT id, size, avg_log2, ratio::DOUBLE AS ratio, floor(cb)::BIGINT AS cache_bytes, row_number() OVER (PARTITION BY ratio ORDER BY avg_log2, size, id DESC) AS k FROM x WHERE size + floor(cb) <= 1200) SELECT id, size, avg_log2, ratio, cache_bytes FROM r WHERE k = 1"
)
def choose_by_cache_ratio(spark, d):
    return tune.choose_by_ratio(_configs(spark, d), 1200, [0.25, 0.5, 0.75], bf="id")


#: The greedy scan as a fold over the probes in key order: an open partition and the closed ones.
PART_RANGE = "(0.000001719 * ({l} - {f} + 1) + 0.000004421 + 0.0000004669 * ({l} - {f} + 1))"
PART_POINT = "(0.005 + 0.000001637 * {n} + 0.000001195 * {u})"


def _prefers(n, f, l_, u):
    p, r = PART_POINT.format(n=n, u=u), PART_RANGE.format(f=f, l=l_)
    return f"({n} >= 128 AND {p} - {r} > 0 AND {r} <= 0.95 * {p})"


PARTITION = f"""WITH sq AS (SELECT q.row_id AS query_idx, q.key, coalesce(k.pos, (SELECT count(*) FROM orders_keys)) AS pos FROM line_probes q ASOF LEFT JOIN orders_keys k ON q.key <= k.key),
pr AS (SELECT (row_number() OVER (ORDER BY key, query_idx) - 1)::BIGINT AS ord, (greatest(pos - 16, 0) // 512)::BIGINT AS lo, ((pos + 16) // 512)::BIGINT AS hi FROM sq),
st AS (SELECT list_prepend({{'o': -1::BIGINT, 'a': 0::BIGINT, 'z': 0::BIGINT, 'n': 0::BIGINT, 'f': 0::BIGINT, 'l': 0::BIGINT, 'u': 0::BIGINT, 'r': 0::BIGINT, 's': 0::BIGINT, 'out': []::STRUCT(s BIGINT, n BIGINT, g INTEGER, u BIGINT, k BIGINT)[]}},
  list({{'o': ord, 'a': lo, 'z': hi, 'n': 0::BIGINT, 'f': 0::BIGINT, 'l': 0::BIGINT, 'u': 0::BIGINT, 'r': 0::BIGINT, 's': 0::BIGINT, 'out': []::STRUCT(s BIGINT, n BIGINT, g INTEGER, u BIGINT, k BIGINT)[]}} ORDER BY ord)) AS rows FROM pr),
opened AS (SELECT list_reduce(rows, lambda s, x: CASE WHEN s.n > 0 AND s.n >= 128 AND (s.l - s.f + 1 >= 64 OR {_prefers('s.n', 's.f', 's.l', 's.u')})
    THEN {{'o': x.o, 'a': x.a, 'z': x.z, 'n': 1::BIGINT, 'f': x.a, 'l': x.z, 'u': x.z - x.a + 1, 'r': x.z, 's': x.o, 'out': list_append(s.out, {{'s': s.s, 'n': s.n, 'g': {_prefers('s.n', 's.f', 's.l', 's.u')}::INTEGER, 'u': s.u, 'k': s.l - s.f + 1}})}}
    WHEN s.n = 0 THEN {{'o': x.o, 'a': x.a, 'z': x.z, 'n': 1::BIGINT, 'f': x.a, 'l': x.z, 'u': x.z - x.a + 1, 'r': x.z, 's': x.o, 'out': s.out}}
    ELSE {{'o': x.o, 'a': x.a, 'z': x.z, 'n': s.n + 1, 'f': least(s.f, x.a), 'l': greatest(s.l, x.z), 'u': s.u + CASE WHEN x.a > s.r THEN x.z - x.a + 1 ELSE greatest(0, x.z - s.r) END, 'r': greatest(s.r, x.z), 's': s.s, 'out': s.out}} END) AS e FROM st),
parts AS (SELECT unnest(list_append(e.out, {{'s': e.s, 'n': e.n, 'g': {_prefers('e.n', 'e.f', 'e.l', 'e.u')}::INTEGER, 'u': e.u, 'k': e.l - e.f + 1}})) AS p FROM opened)
SELECT (row_number() OVER (ORDER BY p.s) - 1)::BIGINT AS part_id, p.s AS start, p.n AS len, p.g AS is_range, p.u AS pages, p.k AS span FROM parts"""


@query(PARTITION, "orders_keys line_probes")
def join_partition(spark, d):
    outer = I.line_probes(spark, d).select(F.col("row_id").alias("query_idx"), "key")
    return join_cost.partition_probes(outer, I.orders_keys(spark, d), 16, join_cost.JoinCost(n_min=128, k_max=64))


@query("SELECT count(*) AS matched_records, sum(q.key)::VARCHAR AS checksum, 0::BIGINT AS record_checksum FROM line_probes q JOIN orders_keys k ON q.key = k.key", "orders_keys line_probes")
def join_hybrid_planned(spark, d):
    """The hybrid join over the greedy partitioner's own partitions."""
    from pagelore.operators import joins

    outer, inner = I.line_probes(spark, d), I.orders_keys(spark, d)
    parts = join_cost.partition_probes(outer.select(F.col("row_id").alias("query_idx"), "key"), inner, 16, join_cost.JoinCost(n_min=128, k_max=64, delta=1e-6))
    return joins.join_summary(joins.join(outer, inner, "hybrid", parts.select("part_id", "len", "is_range")), "hybrid").withColumn("checksum", F.col("checksum").cast("string"))


#: Synthetic calibration rows: orders stand for runs.
RUNS = "runs AS (SELECT (o_orderkey % 50 + 1)::BIGINT AS num_queries, (o_custkey % 64 + 1)::BIGINT AS range_pages, (o_orderkey % 97 + 1)::BIGINT AS IOs, o_totalprice / 1000 AS IO_time_s, o_totalprice / 1000 + (o_orderkey % 50 + 1) * 0.25 + (o_custkey % 7) * 0.01 AS total_wall_time_s FROM orders)"


def _runs(spark, d):
    o = table(spark, d, "orders")
    return o.select((F.col("o_orderkey") % 50 + 1).alias("num_queries"), (F.col("o_custkey") % 64 + 1).alias("range_pages"), (F.col("o_orderkey") % 97 + 1).alias("IOs"), (F.col("o_totalprice") / 1000).alias("IO_time_s"), (F.col("o_totalprice") / 1000 + (F.col("o_orderkey") % 50 + 1) * 0.25 + (F.col("o_custkey") % 7) * 0.01).alias("total_wall_time_s"))


def _fit_sql(a, b, c, x):
    return f"""WITH {RUNS}, l AS (SELECT IO_time_s / IOs AS l FROM runs WHERE IOs > 0), q AS (SELECT quantile_cont(l, 0.25) AS a, quantile_cont(l, 0.75) AS b FROM l)
SELECT round(regr_slope(total_wall_time_s - IO_time_s, {x}), 6) AS {a}, round(regr_intercept(total_wall_time_s - IO_time_s, {x}), 6) AS {b}, (SELECT round(quantile_cont(l, 0.5), 6) FROM l, q WHERE l BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)) AS {c} FROM runs"""


@query(_fit_sql("alpha", "delta", "lambda_point", "num_queries"))
def join_cost_fit_point(spark, d):
    return join_cost.fit_point(_runs(spark, d)).select(*[F.round(c, 6).alias(c) for c in ("alpha", "delta", "lambda_point")])


@query(_fit_sql("beta", "eta", "lambda_range", "range_pages"))
def join_cost_fit_range(spark, d):
    return join_cost.fit_range(_runs(spark, d)).select(*[F.round(c, 6).alias(c) for c in ("beta", "eta", "lambda_range")])


def _unit(*parts):
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(f'({p})::VARCHAR' for p in parts)})), 1, 13))::BIGINT / 4503599627370496.0)"


def _zipf(u, n):
    return f"least(floor(pow((pow(({n}) + 1, -0.2) - 1) * {u} + 1, 1 / -0.2)) - 1, ({n}) - 1)::BIGINT"


def _positions(q, mixture):
    """The mixture of q probes, ten hotspots of a thousandth each, as SQL: mix(query_idx, pos)."""
    hot, zipf = round(q * mixture[0]), round(q * mixture[1])
    return f"""rel AS (SELECT count(*)::BIGINT AS n, greatest(1, floor(count(*) * 0.001))::BIGINT AS width FROM events_keys),
draw AS (SELECT id, {_unit(42, "'u'", 'id')} AS u, {_unit(42, "'v'", 'id')} AS v, {_unit(42, "'o'", 'id')} AS o FROM range({q}) t(id)),
placed AS (SELECT id, o, CASE WHEN id < {hot} THEN least(floor({_unit(42, "'spot'", 'least(floor(u * 10), 9)::BIGINT')} * greatest(1, n - width + 1))::BIGINT + {_zipf('v', 'width')}, n - 1)
  WHEN id < {hot + zipf} THEN {_zipf('u', 'n')} ELSE least(floor(u * n), n - 1)::BIGINT END AS pos FROM draw, rel),
mix AS (SELECT (row_number() OVER (ORDER BY o, id) - 1)::BIGINT AS query_idx, pos FROM placed)"""


@query(f"WITH {_positions(5000, workload.MIXTURES['w4'])} SELECT query_idx, pos, key FROM mix JOIN events_keys USING (pos)", "events_keys")
def workload_mixture(spark, d):
    k = I.events_keys(spark, d)
    return workload.keys_at(workload.mixture_positions(spark, 5000, k.count(), workload.MIXTURES["w4"]), k)


#: The named workloads of one kind each, together.
PURE = {"w1": workload.MIXTURES["w1"], "w2": workload.MIXTURES["w2"], "w3": workload.MIXTURES["w3"]}


@query(" UNION ALL ".join(f"SELECT * FROM (WITH {_positions(1000, m)} SELECT '{w}' AS workload, query_idx, pos FROM mix)" for w, m in PURE.items()), "events_keys")
def workload_pure(spark, d):
    """Uniform, Zipf and hotspot probes."""
    from pagelore.operators.report import union_all

    n = I.events_keys(spark, d).count()
    return union_all([workload.mixture_positions(spark, 1000, n, m).select(F.lit(w).alias("workload"), "query_idx", "pos") for w, m in PURE.items()])


#: Counts by window and kind of the windowed workload: drawn once on the driver, fixed by the seed.
WINDOWS = [(w, k, int(c)) for w, row in enumerate(workload.allocate_windows(5000, 10, workload.MIXTURES["w5"], 0.1, 42)) for k, c in enumerate(row) if c]


@query(
    f"""WITH rel AS (SELECT count(*)::BIGINT AS n, greatest(1, floor(count(*) * 0.001))::BIGINT AS width FROM events_keys),
slots AS (SELECT w, kind, unnest(range(1, c + 1)) AS i FROM (VALUES {', '.join(map(str, WINDOWS))}) t(w, kind, c)),
draw AS (SELECT w, kind, i, {_unit(42, "'u'", 'w', 'kind', 'i')} AS u, {_unit(42, "'v'", 'w', 'kind', 'i')} AS v, {_unit(42, "'o'", 'w', 'kind', 'i')} AS o FROM slots)
SELECT (row_number() OVER (ORDER BY w, o, kind, i) - 1)::BIGINT AS query_idx, w::INTEGER AS w, CASE kind WHEN 0 THEN least(floor({_unit(42, "'spot'", 'least(floor(u * 10), 9)::BIGINT')} * greatest(1, n - width + 1))::BIGINT + {_zipf('v', 'width')}, n - 1)
  WHEN 1 THEN {_zipf('u', 'n')} ELSE least(floor(u * n), n - 1)::BIGINT END AS pos FROM draw, rel""",
    "events_keys",
)
def workload_windowed(spark, d):
    k = I.events_keys(spark, d)
    return workload.windowed_positions(spark, 5000, k.count(), workload.MIXTURES["w5"])


@query(f"WITH {_positions(2000, workload.MIXTURES['w6'])} SELECT query_idx, pos AS rank_lo, least(pos + 1 + floor({_unit(42, chr(39) + 'len' + chr(39), 'query_idx')} * 256)::BIGINT - 1, n - 1) AS rank_hi FROM mix, rel", "events_keys")
def workload_ranges(spark, d):
    n = I.events_keys(spark, d).count()
    return workload.range_workload(workload.mixture_positions(spark, 2000, n, workload.MIXTURES["w6"]), n, 1, 256)


@query(f"WITH {_positions(5000, (0.4, 0.3, 0.3))}, f AS (SELECT pos, min(query_idx) AS seen FROM mix GROUP BY pos), r AS (SELECT pos, (row_number() OVER (ORDER BY seen) - 1)::BIGINT AS query_idx FROM f) SELECT query_idx, pos FROM r WHERE query_idx < 500", "events_keys")
def workload_unique(spark, d):
    n = I.events_keys(spark, d).count()
    return workload.unique_sample(workload.mixture_positions(spark, 5000, n), 500)


@query(
    f"""WITH e AS (SELECT min(key) AS a, max(key) AS b, count(*)::BIGINT AS n FROM events_keys)
SELECT id AS query_idx, k.key FROM (SELECT id, least(floor({_unit(42, "'h'", 'id')} * n), n - 1)::BIGINT AS pos FROM range(1500) t(id), e) JOIN events_keys k USING (pos)
UNION ALL SELECT id, (a + floor({_unit(42, "'m'", 'id')} * (b - a)))::BIGINT FROM range(1500, 2000) t(id), e""",
    "events_keys",
)
def workload_lookup_mix(spark, d):
    """Three quarters of existing keys, the others anywhere between the ends."""
    return workload.lookup_mix(I.events_keys(spark, d), 2000, 0.75)


@query(
    f"""SELECT id AS query_idx, lo, least(lo + floor(span)::BIGINT, 1000000) AS hi FROM (SELECT id, floor(1000 + 999000 * {_unit(42, "'a'", 'id')})::BIGINT AS lo, -500.0 * ln(1 - {_unit(42, "'c'", 'id')}) AS span FROM range(3000) t(id))"""
)
def workload_key_ranges(spark, d):
    """Ranges over the key space: uniform starts, exponential lengths."""
    return workload.key_space_ranges(spark, 3000, 1000, 1_000_000, 500.0, "uniform", "exponential")


@query("SELECT query_idx, key, rate::DOUBLE AS rate FROM event_probes, (VALUES (0.1), (0.5), (1.0)) r(rate) WHERE query_idx < greatest(1, floor((SELECT count(*) FROM events) * rate))", "event_probes")
def workload_prefixes(spark, d):
    return workload.prefixes(I.event_probes(spark, d), [0.1, 0.5, 1.0])


#: Anchor sizes by count of orders, stand-ins for measured index sizes; c by a grid, a and b by least squares on logarithms.
@query(
    """WITH an AS (SELECT (8 * pow(2, o_orderkey % 6))::BIGINT AS eps, (sum(o_totalprice) / pow(2, o_orderkey % 6) / 1000)::BIGINT + 500 AS size FROM orders GROUP BY o_orderkey % 6),
g AS (SELECT i, 0.95 * (SELECT min(size) FROM an) * i / 63 AS c FROM range(64) t(i)),
f AS (SELECT i, any_value(c) AS c, regr_slope(ln(size - c), ln(eps)) AS k, regr_intercept(ln(size - c), ln(eps)) AS la FROM an, g GROUP BY i),
e AS (SELECT f.i, any_value(f.c) AS c, any_value(k) AS k, any_value(la) AS la, avg(pow((exp(la) * pow(eps, k) + f.c) / size - 1, 2)) AS off FROM an, f GROUP BY f.i)
SELECT round(arg_min(exp(la), off) / arg_min(c + 1, off), 4) AS a_share, round(-arg_min(k, off), 4) AS b, round(arg_min(c, off), 1) AS c FROM e"""
)
def size_law_grid(spark, d):
    o = table(spark, d, "orders").groupBy((F.col("o_orderkey") % 6).alias("k")).agg(F.sum("o_totalprice").alias("s"))
    anchors = {r.eps: r.size for r in o.select((8 * F.pow(F.lit(2), "k")).cast("bigint").alias("eps"), (F.round(F.col("s") / F.pow(F.lit(2), "k") / 1000).cast("bigint") + 500).alias("size")).collect()}
    law = tune.grid_law(*tune.positive(anchors))
    return spark.createDataFrame([(round(law.a / (law.c + 1), 4), round(law.b, 4), round(law.c, 1))], "a_share double, b double, c double")


@query("SELECT round(exp(regr_intercept(ln(n), ln(e))), 6) AS a, round(regr_slope(ln(n), ln(e)), 6) AS b FROM (SELECT (o_orderkey % 30 + 2)::DOUBLE AS e, count(*)::DOUBLE AS n FROM orders GROUP BY 1)")
def segment_count_law(spark, d):
    r = table(spark, d, "orders").groupBy((F.col("o_orderkey") % 30 + 2).alias("e")).count().collect()
    a, b = tune.fit_segment_counts([(x.e, x["count"]) for x in r])
    return spark.createDataFrame([(round(a, 6), round(b, 6))], "a double, b double")


@query("SELECT round(regr_slope(o_totalprice, o_custkey), 6) AS slope, round(regr_intercept(o_totalprice, o_custkey), 4) AS intercept, round(regr_r2(o_totalprice, o_custkey), 9) AS r2 FROM orders")
def affine_fit(spark, d):
    return tune.linear_fit(table(spark, d, "orders"), "o_custkey", "o_totalprice").select(F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 9).alias("r2"))


@query("""WITH m AS (SELECT avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my FROM (SELECT o_custkey::DOUBLE AS x, o_totalprice AS y FROM orders)), z AS (SELECT (o_custkey - mx) / sx AS z, o_totalprice - my AS y FROM orders, m),
w AS (SELECT sum(z * y) / (sum(z * z) + 50) AS w FROM z) SELECT round(w / sx, 6) AS weight, round(my - w * mx / sx, 4) AS intercept FROM w, m""")
def ridge_fit(spark, d):
    """One standardised feature: the weight shrinks, the intercept doesn't."""
    w, b = tune.fit_ridge_standardized(table(spark, d, "orders"), {"x": F.col("o_custkey").cast("double")}, "o_totalprice", 50.0)
    return spark.createDataFrame([(round(float(w[0]), 6), round(b, 4))], "weight double, intercept double")


@query("""WITH r AS (SELECT (o_custkey % 3)::BIGINT AS M, (o_orderkey % 40)::DOUBLE AS e, o_totalprice AS act, o_totalprice * 0.8 + o_orderkey % 40 AS est FROM orders),
f AS (SELECT b.M, regr_slope(act - est, e) AS k, regr_intercept(act - est, e) AS c FROM r, (SELECT DISTINCT M FROM r) b WHERE r.M <> b.M GROUP BY b.M)
SELECT M, round(avg(abs(est - act)), 4) AS mae_before, round(avg(abs(greatest(est + c + k * e, 0) - act)), 4) AS mae_after, round(sqrt(avg(pow(est - act, 2))), 4) AS rmse_before, round(sqrt(avg(pow(greatest(est + c + k * e, 0) - act, 2))), 4) AS rmse_after FROM r JOIN f USING (M) GROUP BY M""")
def residual_holdout(spark, d):
    """Corrections fitted without a memory budget, held against it."""
    r = table(spark, d, "orders").select((F.col("o_custkey") % 3).alias("M"), (F.col("o_orderkey") % 40).cast("double").alias("e"), F.col("o_totalprice").alias("act"), (F.col("o_totalprice") * 0.8 + F.col("o_orderkey") % 40).alias("est"))
    rows = tune.holdout_by_memory(r, "act", "est", [F.lit(1.0), F.col("e")])
    cols = ("mae_before", "mae_after", "rmse_before", "rmse_after")
    return spark.createDataFrame([(x["M"], *[round(x[c], 4) for c in cols]) for x in rows], "M bigint, " + ", ".join(f"{c} double" for c in cols))


@query(
    RANKS + _weights("(VALUES (16), (32), (64), (128)) e(eps)") + """, g AS (SELECT eps, page_id, sum(p) AS refs, max(p >= 1) AS certain, sum(CASE WHEN p < 1 THEN ln(1 - p) ELSE 0 END) AS lm FROM c GROUP BY ALL),
s AS (SELECT eps, sum(refs) AS total, sum(CASE WHEN certain THEN 1 ELSE 1 - exp(lm) END) AS dist FROM g GROUP BY eps),
m AS (SELECT eps, (16 * (SELECT count(*) FROM events_keys)) // (2 * eps) AS size, (24576 - (16 * (SELECT count(*) FROM events_keys)) // (2 * eps)) // 4096 AS cap FROM (VALUES (2), (16), (32), (64), (128)) e(eps)),
o AS (SELECT eps, refs, row_number() OVER (PARTITION BY eps ORDER BY refs DESC) AS r FROM g),
h AS (SELECT o.eps, sum(refs) FILTER (WHERE r <= cap) / any_value(total) AS h, any_value(1 - dist / total) AS most FROM o JOIN s USING (eps) JOIN m USING (eps) GROUP BY o.eps),
k AS (SELECT m.eps::INTEGER AS eps, size AS index_bytes, size < 24576 AS feasible, round((1 - least(h, most)) * (1 + 2 * m.eps / 512), 6) AS cost FROM m LEFT JOIN h ON m.eps = h.eps AND size < 24576 AND cap >= 1)
SELECT * REPLACE (coalesce(cost, -1) AS cost), eps = (SELECT arg_min(eps, (cost, eps)) FROM k WHERE cost IS NOT NULL) AS chosen FROM k""",
    "events_keys event_probes",
)
def tune_epsilon(spark, d):
    """The cheapest epsilon by estimated LFU cost under a budget that the smallest index bursts."""
    k = I.events_keys(spark, d)
    r = keys.predecessor(I.event_probes(spark, d), k).select("pos")
    return tune.choose_epsilon(r, k.count(), [2, 16, 32, 64, 128], 24_576, policy="LFU").withColumn("cost", F.coalesce(F.round("cost", 6), F.lit(-1.0)))


@query()
def tune_epsilon_measured(spark, d):
    """The same with sizes by a power law of measured anchors, under LRU."""
    k = I.events_keys(spark, d)
    r = keys.predecessor(I.event_probes(spark, d), k).select("pos")
    sizes = {x.epsilon: x.measured_index_bytes for x in pgm.index_sizes(k, [8, 32, 128]).collect()}
    return tune.choose_epsilon(r, k.count(), [8, 16, 32, 64, 128], 49_152, tune.fit_power_law(sizes))


@query()
def tune_epsilon_space(spark, d):
    k = I.events_keys(spark, d)
    eps, seen = tune.tune_for_space(k, 2048, 2, 512)
    return spark.createDataFrame([(e, s, e == eps) for e, s in seen], "eps bigint, bytes bigint, chosen boolean")


@query()
def sort_cache_tradeoff(spark, d):
    """Unsorted probes with the whole budget as cache beside sorted ones whose cache gave way to the sort."""
    from pagelore.operators.joins import sort_budget_bytes
    from pagelore.operators.predict import Exact

    k, p = I.events_keys(spark, d), I.event_probes(spark, d)
    n = p.count()
    memory = sort_budget_bytes(n) + 12 * 4096
    cfg = lambda m: [{"policy": x, "capacity": cache.capacity_pages(m)} for x in ("FIFO", "LRU", "LFU")]
    mix = keys.ordinal(p.select(F.xxhash64("query_idx").alias("_o"), "query_idx", "key"), ["_o", "query_idx"], "at").select(F.col("at").alias("query_idx"), "key")
    a = cache.replay_summary(cache.replay(access.page_trace(access.point_lookup(mix, k, Exact(k, 64))), cfg(memory))).withColumn("order", F.lit("original"))
    by_key = keys.ordinal(p.select("key", "query_idx"), ["key", "query_idx"], "at").select(F.col("at").alias("query_idx"), "key")
    left = max(0, memory - sort_budget_bytes(n))
    b = cache.replay_summary(cache.replay(access.page_trace(access.point_lookup(by_key, k, Exact(k, 64))), cfg(left))).withColumn("order", F.lit("sorted"))
    return a.unionByName(b)


@query(
    RANKS + ", r AS (SELECT pos % 50 AS epsilon, pos % 7 AS M, (pos % 13) * 0.5 AS est FROM ranks), a AS (SELECT epsilon, M, est, est + 0.25 + 0.01 * epsilon AS act FROM r) SELECT round(regr_slope(act - est, epsilon), 6) AS slope, round(regr_intercept(act - est, epsilon), 6) AS intercept, round(avg(abs(est - act)), 6) AS mae, round(sqrt(avg((est - act) * (est - act))), 6) AS rmse, 0.0::DOUBLE AS mae_after FROM a",
    "events_keys event_probes",
)
def residual_correction(spark, d):
    """Residuals of a known law: the fit finds it, the corrected error is zero."""
    k = I.events_keys(spark, d)
    r = keys.predecessor(I.event_probes(spark, d), k).select((F.col("pos") % 50).cast("double").alias("epsilon"), (F.col("pos") % 7).cast("double").alias("M"), ((F.col("pos") % 13) * 0.5).alias("est"))
    r = r.withColumn("act", F.col("est") + 0.25 + 0.01 * F.col("epsilon"))
    f = tune.residual_features()
    w = tune.fit_residuals(r, "act", "est", f)
    line, off = tune.linear_fit(r.withColumn("res", F.col("act") - F.col("est")), "epsilon", "res").first(), tune.error_summary(r, "act", "est").first()
    after = tune.error_summary(tune.correct(r, "est", f, w), "act", "corrected").first()
    return spark.createDataFrame([(round(line.slope, 6), round(line.intercept, 6), round(off.mae, 6), round(off.rmse, 6), abs(round(after.mae, 6)))], "slope double, intercept double, mae double, rmse double, mae_after double")
