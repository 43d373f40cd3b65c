"""Queries on cache replay, hit ratios and cost estimates."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelore.operators import access, cache, costs, hitmodels, keys
from pagelore.operators.predict import Exact
from pagelore.plans import inputs as I
from pagelore.plans.access_queries import EPS, WINDOW, _looked
from pagelore.plans.base import query
from pagelore.runtime import table

TRACE = f"WITH {WINDOW}, t0 AS (SELECT query_idx, unnest(range(page_lo, page_lo + dac)) AS page_id, generate_subscripts(range(page_lo, page_lo + dac), 1) - 1 AS seq FROM looked),\nt AS (SELECT *, row_number() OVER (ORDER BY query_idx, seq) AS i FROM t0)"
#: An LRU cache hits if fewer than its capacity of other pages came since the page's last request.
LRU = TRACE + """, p AS (SELECT *, lag(i) OVER (PARTITION BY page_id ORDER BY i) AS prev FROM t),
dist AS (SELECT a.query_idx, a.seq, a.page_id, a.i, a.prev, count(b.i) AS between_ FROM p a LEFT JOIN p b ON b.i > a.prev AND b.i < a.i AND coalesce(b.prev, 0) <= a.prev GROUP BY ALL),
hits AS (SELECT *, prev IS NOT NULL AND between_ < {c} AS hit FROM dist)"""


def _trace(spark, d):
    return access.page_trace(_looked(spark, d, "all_in_once"))


@query(LRU.replace("{c}", "8") + " SELECT query_idx, seq, page_id, hit FROM hits", "events_keys event_probes")
def replay_lru(spark, d):
    return cache.replay(_trace(spark, d), [{"policy": "LRU", "capacity": 8}]).select("query_idx", F.col("seq").cast("bigint").alias("seq"), "page_id", "hit")


#: A replay as a fold over the requests in order: the pages held, in the order of eviction, and the hits so far.
FOLD = """, ordered AS (SELECT list_prepend({{'p': -1::BIGINT, 'held': []::{kind}[], 'hits': []::BOOLEAN[]}}, list({{'p': page_id, 'held': []::{kind}[], 'hits': []::BOOLEAN[]}} ORDER BY i)) AS rows FROM t),
done AS (SELECT (list_reduce(rows, lambda s, x: {{'p': x.p, 'held': {held}, 'hits': list_append(s.hits, {hit})}})).hits AS h FROM ordered),
hits AS (SELECT unnest(h) AS hit, generate_subscripts(h, 1) AS i FROM done)"""


def fold(policy, c):
    if policy == "FIFO":
        hit = "list_contains(s.held, x.p)"
        return FOLD.format(kind="BIGINT", hit=hit, held=f"CASE WHEN {hit} THEN s.held WHEN len(s.held) >= {c} THEN list_append(s.held[2:], x.p) ELSE list_append(s.held, x.p) END")
    if policy == "LRU":
        hit = "list_contains(s.held, x.p)"
        return FOLD.format(kind="BIGINT", hit=hit, held=f"CASE WHEN {hit} THEN list_append(list_filter(s.held, lambda e: e <> x.p), x.p) WHEN len(s.held) >= {c} THEN list_append(s.held[2:], x.p) ELSE list_append(s.held, x.p) END")
    own = "list_filter(s.held, lambda e: e.p = x.p)"
    least = "list_filter(s.held, lambda e: e.n = list_min(list_transform(s.held, lambda m: m.n)))[1].p"
    one = "{'p': x.p, 'n': 1::BIGINT}"
    held = f"CASE WHEN len({own}) > 0 THEN list_append(list_filter(s.held, lambda e: e.p <> x.p), {{'p': x.p, 'n': {own}[1].n + 1}}) WHEN len(s.held) >= {c} THEN list_append(list_filter(s.held, lambda e: e.p <> {least}), {one}) ELSE list_append(s.held, {one}) END"
    return FOLD.format(kind="STRUCT(p BIGINT, n BIGINT)", hit=f"len({own}) > 0", held=held)


def _replay_sql(policy, c=8):
    return TRACE + fold(policy, c) + " SELECT t.query_idx, t.seq, t.page_id, hits.hit FROM t JOIN hits USING (i)"


@query(_replay_sql("FIFO"), "events_keys event_probes")
def replay_fifo(spark, d):
    return cache.replay(_trace(spark, d), [{"policy": "FIFO", "capacity": 8}]).select("query_idx", F.col("seq").cast("bigint").alias("seq"), "page_id", "hit")


@query(_replay_sql("LFU"), "events_keys event_probes")
def replay_lfu(spark, d):
    return cache.replay(_trace(spark, d), [{"policy": "LFU", "capacity": 8}]).select("query_idx", F.col("seq").cast("bigint").alias("seq"), "page_id", "hit")


def _totals_sql(cases):
    """Requests, hits and means of each (policy, capacity)."""
    return " UNION ALL ".join(
        f"SELECT * FROM ({TRACE}{fold(p, c)} SELECT '{p}' AS policy, {c}::INTEGER AS capacity, (SELECT count(DISTINCT query_idx) FROM t) AS queries, count(*) AS total_dac, count(*) FILTER (WHERE hit) AS total_hits, count(*) FILTER (WHERE NOT hit) AS total_misses, round(avg(hit::INTEGER), 9) AS hit_ratio FROM hits)"
        for p, c in cases
    )


@query(_totals_sql([(p, c) for p in ("FIFO", "LRU", "LFU") for c in (2, 8)]), "events_keys event_probes")
def replay_totals(spark, d):
    """Every policy, two capacities, pages stored right after their miss."""
    cfg = [{"policy": p, "capacity": c} for p in ("FIFO", "LRU", "LFU") for c in (2, 8)]
    return cache.replay_summary(cache.replay(_trace(spark, d), cfg)).select("policy", "capacity", "queries", "total_dac", "total_hits", "total_misses", F.round("hit_ratio", 9).alias("hit_ratio"))


@query(
    TRACE + """, pg AS (SELECT DISTINCT page_id FROM t), seen AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) AS nth FROM t)
SELECT count(*) AS requests, count(*) FILTER (WHERE nth > 1 OR page_id < 20) AS hits FROM seen""",
    "events_keys event_probes",
)
def replay_warmed(spark, d):
    """A cache that holds everything, filled with the first twenty pages before the first request."""
    r = cache.replay(_trace(spark, d), [{"policy": "LRU", "capacity": 1 << 20}], warm=list(range(20)))
    return r.agg(F.count("*").alias("requests"), F.sum(F.col("hit").cast("bigint")).alias("hits"))


@query()
def replay_summaries(spark, d):
    """Every policy, two capacities, both ways to store what was missed."""
    cfg = [{"policy": p, "capacity": c, "put_mode": m} for p in ("NONE", "FIFO", "LRU", "LFU") for c in (2, 8) for m in ("immediate", "deferred")]
    return cache.replay(_trace(spark, d), cfg).groupBy("config", "policy", "capacity").agg(F.count("*").alias("requests"), F.sum(F.col("hit").cast("bigint")).alias("hits"))


@query(LRU.replace("{c}", "8") + """, r AS (SELECT *, NOT hit AND (coalesce(lag(hit) OVER w, true) OR page_id <> lag(page_id) OVER w + 1) AS new FROM hits WINDOW w AS (PARTITION BY query_idx ORDER BY seq))
SELECT query_idx, count(*) AS dac, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses, count(*) FILTER (WHERE new) AS device_ios FROM r GROUP BY query_idx""", "events_keys event_probes")
def miss_runs(spark, d):
    return access.query_metrics(cache.replay(_trace(spark, d), [{"policy": "LRU", "capacity": 8}]))


@query(LRU.replace("{c}", "8") + """, q AS (SELECT query_idx, count(*)::DOUBLE AS dac, count(*) FILTER (WHERE hit) / count(*) AS h, count(*) FILTER (WHERE NOT hit)::DOUBLE AS io FROM hits GROUP BY query_idx)
SELECT count(*) AS queries, round(avg(h), 6) AS mean_h, round(avg(dac), 6) AS mean_dac, round(var_pop(h), 6) AS var_h, round(var_pop(dac), 6) AS var_dac, round(covar_pop(h, dac), 6) AS cov, round(avg(io), 6) AS mean_io FROM q""", "events_keys event_probes")
def hit_dac_covariance(spark, d):
    m = access.query_metrics(cache.replay(_trace(spark, d), [{"policy": "LRU", "capacity": 8}]))
    return costs.hit_dac_covariance(m).select("queries", *[F.round(c, 6).alias(c) for c in ("mean_h", "mean_dac", "var_h", "var_dac", "cov", "mean_io")])


POP = TRACE + ", pop AS (SELECT page_id, count(*) AS refs FROM t GROUP BY page_id), hist AS (SELECT refs, count(*) AS n, refs / (SELECT sum(refs) FROM pop) AS q FROM pop GROUP BY refs)"


def _solver(name, term, cap):
    sql = POP.replace("WITH ", "WITH RECURSIVE ", 1) + f""", b(i, lo, hi) AS (SELECT 0, 0.0::DOUBLE, 1e9::DOUBLE UNION ALL
  SELECT b.i + 1, CASE WHEN s.v < {cap} THEN (b.lo + b.hi) / 2 ELSE b.lo END, CASE WHEN s.v < {cap} THEN b.hi ELSE (b.lo + b.hi) / 2 END
  FROM b, LATERAL (SELECT sum(n * {term.replace('TT', '((b.lo + b.hi) / 2)')}) AS v FROM hist) s WHERE b.i < 90)
SELECT CASE WHEN (SELECT count(*) FROM pop) <= {cap} THEN 'infinity'::DOUBLE ELSE round(time, 3) END AS time, round((SELECT sum(n * q * {term.replace('TT', 'time')}) FROM hist), 6) AS hit_ratio FROM (SELECT (lo + hi) / 2 AS time FROM b WHERE i = 90)"""

    @query(sql, "events_keys event_probes", name=name)
    def run(spark, d):
        p = hitmodels.Popularity(cache.popularity(_trace(spark, d)))
        t, h = (hitmodels.che_time, hitmodels.lru_hit_ratio) if name == "che_lru" else (hitmodels.fifo_time, hitmodels.fifo_hit_ratio)
        return spark.createDataFrame([(round(t(p, cap), 3), round(h(p, cap), 6))], "time double, hit_ratio double")


_solver("che_lru", "(1 - exp(-q * TT))", 8)
_solver("fifo_model", "(q * TT / (1 - q + q * TT))", 8)


@query(POP + " SELECT round(sum(refs) / (SELECT sum(refs) FROM pop), 6) AS hit_ratio FROM (SELECT refs FROM pop ORDER BY refs DESC LIMIT 8)", "events_keys event_probes")
def lfu_hit_ratio(spark, d):
    p = hitmodels.Popularity(cache.popularity(_trace(spark, d)))
    return spark.createDataFrame([(round(hitmodels.lfu_hit_ratio(p, 8), 6),)], "hit_ratio double")


@query(POP + " SELECT page_id, refs, CASE WHEN row_number() OVER (ORDER BY refs DESC, page_id) <= 8 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit_prob FROM pop", "events_keys event_probes")
def lfu_page_hit_probs(spark, d):
    return hitmodels.page_hit_probs(cache.popularity(_trace(spark, d)), "LFU", 8).select("page_id", "refs", "hit_prob")


RANKS = "WITH ranks AS (SELECT coalesce(k.pos, 0) AS pos FROM event_probes q ASOF LEFT JOIN events_keys k ON q.key >= k.key), pg AS (SELECT (count(*) + 511) // 512 AS pages FROM events_keys)"


def _weights(eps_rel):
    """Page weights by the displacement formula; eps_rel is a relation e(eps)."""
    return f""", x AS (SELECT eps, pos // 512 AS p, pos % 512 AS s, unnest(range(floor(-2 * eps / 512)::BIGINT, floor((511 + 2 * eps) / 512)::BIGINT + 1)) AS d FROM ranks, {eps_rel}),
w AS (SELECT eps, p + d AS page_id, greatest(0, least(eps, (d + 1) * 512 - 1 - s + eps) - greatest(-eps, d * 512 - s - eps) + 1) / (2 * eps + 1) AS p FROM x),
c AS (SELECT eps, page_id, p FROM w, pg WHERE page_id >= 0 AND page_id < pages AND p > 0)"""


def _ranks(spark, d):
    k = I.events_keys(spark, d)
    return keys.predecessor(I.event_probes(spark, d), k).select("pos"), k.count()


@query(RANKS + _weights("(VALUES (8), (64), (600)) e(eps)") + " SELECT eps, page_id, round(sum(p), 4) AS refs FROM c GROUP BY ALL", "events_keys event_probes")
def page_counts_table(spark, d):
    r, n = _ranks(spark, d)
    return costs.page_counts_table(r, [8, 64, 600], -(-n // 512)).select("eps", "page_id", F.round("refs", 4).alias("refs"))


@query(RANKS + _weights("(VALUES (600)) e(eps)") + " SELECT page_id, round(sum(p), 4) AS refs FROM c GROUP BY page_id", "events_keys event_probes")
def page_counts_diff(spark, d):
    """By difference events: must equal the table form."""
    r, n = _ranks(spark, d)
    return costs.page_counts_diff(r.withColumn("eps", F.lit(600)), -(-n // 512)).select("page_id", F.round("refs", 4).alias("refs"))


@query(
    RANKS + ", q AS (SELECT pos, 16 + 100 * (pos % 3) AS eps FROM ranks)" + _weights("(SELECT 0)").replace("FROM ranks, (SELECT 0)", "FROM q") + " SELECT page_id, round(sum(p), 4) AS refs FROM c GROUP BY page_id",
    "events_keys event_probes",
)
def page_counts_by_query_eps(spark, d):
    r, n = _ranks(spark, d)
    return costs.page_counts_diff(r.withColumn("eps", 16 + 100 * (F.col("pos") % 3)), -(-n // 512)).select("page_id", F.round("refs", 4).alias("refs"))


@query(
    RANKS + _weights("(VALUES (8), (64)) e(eps)") + """, g AS (SELECT eps, page_id, sum(p) AS refs, max(p >= 1) AS certain, sum(CASE WHEN p < 1 THEN ln(1 - p) ELSE 0 END) AS lm FROM c GROUP BY ALL)
SELECT eps, round(sum(CASE WHEN certain THEN 1 ELSE 1 - exp(0.5 * lm) END), 4) AS distinct_pages, round(0.5 * sum(refs), 3) AS requests FROM g GROUP BY eps""",
    "events_keys event_probes",
)
def expected_distinct_pages(spark, d):
    r, n = _ranks(spark, d)
    e = costs.expected_distinct(costs.page_counts_table(r, [8, 64], -(-n // 512)), 0.5)
    return e.select("eps", F.round("distinct_pages", 4).alias("distinct_pages"), F.round("requests", 3).alias("requests"))


RANGE_RANKS = """WITH a AS (SELECT r.query_idx, coalesce(k.pos, 0) AS rank_lo FROM event_ranges r ASOF LEFT JOIN events_keys k ON r.lo >= k.key),
b AS (SELECT r.query_idx, coalesce(k.pos, 0) AS rank_hi FROM event_ranges r ASOF LEFT JOIN events_keys k ON r.hi >= k.key),
rr AS (SELECT query_idx, rank_lo, rank_hi FROM a JOIN b USING (query_idx))"""


def range_ranks(spark, d):
    k, r = I.events_keys(spark, d), I.event_ranges(spark, d)
    r = keys.predecessor(r.withColumn("key", F.col("lo")), k).withColumnRenamed("pos", "rank_lo").drop("key")
    return keys.predecessor(r.withColumn("key", F.col("hi")), k).withColumnRenamed("pos", "rank_hi").select("query_idx", "rank_lo", "rank_hi"), k.count()


@query(
    RANGE_RANKS + """, pg AS (SELECT (count(*) + 511) // 512 AS pages FROM events_keys), w AS (SELECT least(greatest(floor((rank_lo - 32) / 512), 0), pages - 1)::BIGINT AS a, least(greatest(floor((rank_hi + 32) / 512), 0), pages - 1)::BIGINT AS b FROM rr, pg)
SELECT page_id, count(*) AS refs FROM (SELECT unnest(range(a, b + 1)) AS page_id FROM w) GROUP BY page_id""",
    "events_keys event_ranges",
)
def range_page_counts(spark, d):
    r, n = range_ranks(spark, d)
    pages = -(-n // 512)
    return costs.range_page_counts(costs.range_windows_of_ranks(r, 16, pages), pages)


@query(
    RANGE_RANKS + """, u AS (SELECT query_idx, rank_lo, rank_hi, unnest(range(-8, 9)) AS u FROM rr), uv AS (SELECT *, unnest(range(-8, 9)) AS v FROM u)
SELECT query_idx, round(avg(1 + (rank_hi + v + 8) // 512 - greatest(0, rank_lo + u - 8) // 512), 6) AS rdac FROM uv WHERE v >= u - (rank_hi - rank_lo) GROUP BY query_idx""",
    "events_keys event_ranges",
)
def expected_rdac(spark, d):
    r, _ = range_ranks(spark, d)
    return r.select("query_idx", F.round(costs.expected_rdac(F.col("rank_lo"), F.col("rank_hi"), 8), 6).alias("rdac"))


@query(
    "WITH w AS (SELECT greatest(k.pos - 64, 0) // 512 AS a, (least(k.pos + 66, n) - 1) // 512 AS b FROM line_probes q JOIN orders_keys k ON q.key = k.key, (SELECT count(*) AS n FROM orders_keys)), p AS (SELECT unnest(range(a, b + 1)) AS page_id FROM w) SELECT count(*) AS requests, count(DISTINCT page_id) AS distinct_pages, (count(*) - count(DISTINCT page_id)) / count(*) AS hit_ratio FROM p",
    "line_probes orders_keys",
)
def distinct_page_union(spark, d):
    k = I.orders_keys(spark, d)
    p = table(spark, d, "lineitem").select(F.monotonically_increasing_id().alias("query_idx"), F.col("l_orderkey").alias("key"))
    return costs.distinct_pages(Exact(k, EPS).windows(p))


#: Hit ratios of a relation g(eps, page_id, refs) for caps m(memory, eps, cap): characteristic times by bisection for LRU and FIFO.
CAPPED = """, tot AS (SELECT eps, sum(refs) AS total, count(*) AS pages FROM g GROUP BY eps), gq AS (SELECT g.eps, g.refs / total AS q FROM g JOIN tot USING (eps)),
bis(policy, memory, eps, cap, i, lo, hi) AS (SELECT policy, memory, m.eps, cap, 0, 0.0::DOUBLE, 1e9::DOUBLE FROM m JOIN tot USING (eps), (VALUES ('LRU'), ('FIFO')) p(policy) WHERE cap >= 1 AND cap < pages UNION ALL
  SELECT b.policy, b.memory, b.eps, b.cap, b.i + 1, CASE WHEN s.v < b.cap THEN (b.lo + b.hi) / 2 ELSE b.lo END, CASE WHEN s.v < b.cap THEN b.hi ELSE (b.lo + b.hi) / 2 END
  FROM bis b, LATERAL (SELECT sum(CASE b.policy WHEN 'LRU' THEN 1 - exp(-q * (b.lo + b.hi) / 2) ELSE q * (b.lo + b.hi) / 2 / (1 - q + q * (b.lo + b.hi) / 2) END) AS v FROM gq WHERE gq.eps = b.eps) s WHERE b.i < 90),
tt AS (SELECT policy, memory, eps, cap, (lo + hi) / 2 AS t FROM bis WHERE i = 90),
hr AS (SELECT policy, memory, tt.eps, cap, sum(q * CASE policy WHEN 'LRU' THEN 1 - exp(-q * t) ELSE q * t / (1 - q + q * t) END) AS h FROM tt JOIN gq ON gq.eps = tt.eps GROUP BY policy, memory, tt.eps, cap
  UNION ALL SELECT policy, memory, eps, cap, 1 FROM m JOIN tot USING (eps), (VALUES ('LRU'), ('FIFO')) p(policy) WHERE cap >= pages
  UNION ALL SELECT 'LFU', memory, eps, cap, sum(refs) FILTER (WHERE r <= cap) / any_value(total) FROM (SELECT m.memory, g.eps, m.cap, refs, total, row_number() OVER (PARTITION BY m.memory, g.eps ORDER BY refs DESC) AS r FROM m JOIN g USING (eps) JOIN tot USING (eps)) WHERE cap >= 1 GROUP BY memory, eps, cap)"""
POINT_SWEEP = RANKS.replace("WITH ", "WITH RECURSIVE ", 1) + _weights("(VALUES (8), (16), (32), (64), (128)) e(eps)") + """, g AS (SELECT eps, page_id, sum(p) AS refs, max(p >= 1) AS certain, sum(CASE WHEN p < 1 THEN ln(1 - p) ELSE 0 END) AS lm FROM c GROUP BY ALL),
m AS (SELECT memory, eps, (memory - (16 * (SELECT count(*) FROM events_keys)) // (2 * eps)) // 4096 AS cap FROM (VALUES (65536), (131072)) b(memory), (VALUES (8), (16), (32), (64), (128)) e(eps))""" + CAPPED + """,
once AS (SELECT eps, 1 - sum(CASE WHEN certain THEN 1 ELSE 1 - exp(lm) END) / sum(refs) AS most FROM g GROUP BY eps)
SELECT policy, memory::BIGINT AS memory, eps::INTEGER AS eps, cap AS cache_pages, round(greatest(least(h, most), 0), 5) AS hit_ratio, 1 + 2 * eps / 512 AS dac, round((1 - greatest(least(h, most), 0)) * (1 + 2 * eps / 512), 5) AS cost FROM hr JOIN once USING (eps)"""


@query(POINT_SWEEP, "events_keys event_probes")
def point_cost_sweep(spark, d):
    """Cost of each (policy, memory, eps): characteristic times are solved numerically."""
    r, n = _ranks(spark, d)
    c = costs.point_costs(r, n, [8, 16, 32, 64, 128], [65_536, 131_072], ("FIFO", "LRU", "LFU"))
    return c.withColumns({"hit_ratio": F.round("hit_ratio", 5), "cost": F.round("cost", 5)})


@query(
    RANKS + _weights("(VALUES (16), (64)) e(eps)") + """, g AS (SELECT eps, page_id, sum(p) AS refs, max(p >= 1) AS certain, sum(CASE WHEN p < 1 THEN ln(1 - p) ELSE 0 END) AS lm FROM c GROUP BY ALL),
s AS (SELECT eps, sum(refs) AS total, sum(CASE WHEN certain THEN 1 ELSE 1 - exp(lm) END) AS dist FROM g GROUP BY eps),
m AS (SELECT eps, (65536 - (16 * (SELECT count(*) FROM events_keys)) // (2 * eps)) // 4096 AS cap FROM (VALUES (16), (64)) e(eps)),
o AS (SELECT eps, refs, row_number() OVER (PARTITION BY eps ORDER BY refs DESC) AS r FROM g),
h AS (SELECT o.eps, any_value(cap) AS cap, sum(refs) FILTER (WHERE r <= cap) / any_value(total) AS h, any_value(1 - dist / total) AS most FROM o JOIN s USING (eps) JOIN m USING (eps) GROUP BY o.eps)
SELECT eps, cap AS cache_pages, round(least(h, most), 6) AS hit_ratio, round((1 - least(h, most)) * (1 + 2 * eps / 512), 6) AS cost FROM h WHERE cap >= 1""",
    "events_keys event_probes",
)
def cold_start_cap(spark, d):
    """LFU costs under an estimated budget, first requests counted as misses."""
    r, n = _ranks(spark, d)
    return costs.point_costs(r, n, [16, 64], [65_536], ("LFU",)).select("eps", "cache_pages", F.round("hit_ratio", 6).alias("hit_ratio"), F.round("cost", 6).alias("cost"))


@query(
    RANGE_RANKS.replace("WITH ", "WITH RECURSIVE ", 1) + """, pg AS (SELECT (count(*) + 511) // 512 AS pages FROM events_keys),
w AS (SELECT eps, least(greatest(floor((rank_lo - 2 * eps) / 512), 0), pages - 1)::BIGINT AS a, least(greatest(floor((rank_hi + 2 * eps) / 512), 0), pages - 1)::BIGINT AS b FROM rr, pg, (VALUES (8), (64)) e(eps)),
g AS (SELECT eps, page_id, count(*)::DOUBLE AS refs FROM (SELECT eps, unnest(range(a, b + 1)) AS page_id FROM w) GROUP BY ALL),
m AS (SELECT 65536 AS memory, eps, (65536 - (16 * (SELECT count(*) FROM events_keys)) // (2 * eps)) // 4096 AS cap FROM (VALUES (8), (64)) e(eps))""" + CAPPED + """,
once AS (SELECT eps, sum(refs) / (SELECT count(*) FROM rr) AS dac, 1 - count(*) / sum(refs) AS most FROM g GROUP BY eps)
SELECT policy, memory::BIGINT AS memory, eps::INTEGER AS eps, cap AS cache_pages, round(greatest(least(h, most), 0), 5) AS hit_ratio, round(dac, 6) AS dac, round((1 - greatest(least(h, most), 0)) * dac, 5) AS cost FROM hr JOIN once USING (eps)""",
    "events_keys event_ranges",
)
def range_cost_sweep(spark, d):
    r, n = range_ranks(spark, d)
    c = costs.range_costs(r, n, [8, 64], [65_536], ("FIFO", "LRU", "LFU"))
    return c.withColumns({"hit_ratio": F.round("hit_ratio", 5), "dac": F.round("dac", 6), "cost": F.round("cost", 5)})
