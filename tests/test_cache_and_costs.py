import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagelore.operators import cache, costs, hitmodels


def brute(policy, capacity, trace):
    """Caches as plain lists: [page, uses], the front is evicted first."""
    held, hits = [], []
    for p in trace:
        at = next((i for i, (q, _) in enumerate(held) if q == p), None)
        hits.append(at is not None)
        if at is not None:
            if policy != "FIFO":
                q, n = held.pop(at)
                held.append([q, n + 1])
            continue
        if not capacity:
            continue
        if len(held) >= capacity:
            gone = 0 if policy != "LFU" else min(range(len(held)), key=lambda i: (held[i][1], i))
            held.pop(gone)
        held.append([p, 1])
    return hits


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 7), max_size=60), st.integers(0, 4), st.sampled_from(["FIFO", "LRU", "LFU"]))
def test_caches(trace, capacity, policy):
    c, hits = cache.CACHES[policy](capacity), []
    for p in trace:
        hits.append(c.get(p))
        if not hits[-1]:
            c.put(p)
    assert hits == brute(policy, capacity, trace)


def test_replay_put_modes(spark):
    # A hit inside a window is older than the misses before it if those are stored when it is found.
    rows = [(0, 0, 1), (0, 1, 2), (1, 0, 3), (1, 1, 2), (2, 0, 1), (2, 1, 3)]
    t = spark.createDataFrame(rows, "query_idx bigint, seq int, page_id bigint")
    r = cache.replay(t, [{"policy": "LRU", "capacity": 2}, {"policy": "LRU", "capacity": 2, "put_mode": "deferred"}, {"policy": "NONE", "capacity": 9}])
    got = {c: [x.hit for x in sorted(r.where(F.col("config") == c).collect(), key=lambda x: (x.query_idx, x.seq))] for c in (0, 1, 2)}
    assert got[0] == [False, False, False, True, False, False]
    assert got[1] == [False, False, False, True, False, True]
    assert not any(got[2])
    assert cache.replay(t, [{"policy": "FIFO", "capacity": 3}], warm=[1, 2, 3]).where("hit").count() == 6


def test_budgets_and_lists():
    assert cache.parse_policies(" lru,LRU, fifo") == ["LRU", "FIFO"] and cache.parse_policies("all") == ["FIFO", "LRU", "LFU"]
    with pytest.raises(ValueError):
        cache.parse_strategies("sometimes")
    assert cache.cache_bytes("estimated", 10_000, 1000, 8) == 9000 and cache.cache_bytes("RAW", 5) == 5 and cache.cache_bytes("measured", 5, measured=9) == 0


@pytest.mark.parametrize("local", [True, False])
def test_hit_models(spark, local, monkeypatch):
    if not local:
        monkeypatch.setattr(hitmodels, "LOCAL_ROWS", -1)
    refs = [50, 30, 30, 10, 5, 5, 1, 1, 1, 0]
    p = hitmodels.Popularity(spark.createDataFrame([(r,) for r in refs], "refs bigint"))
    q = np.array([r for r in refs if r]) / sum(refs)
    t = hitmodels.che_time(p, 4)
    assert abs((1 - np.exp(-q * t)).sum() - 4) < 1e-6
    assert abs(hitmodels.lru_hit_ratio(p, 4) - (q * (1 - np.exp(-q * t))).sum()) < 1e-9
    f = hitmodels.fifo_time(p, 4)
    assert abs((q * f / (1 - q + q * f)).sum() - 4) < 1e-6
    assert abs(hitmodels.lfu_hit_ratio(p, 4) - np.sort(q)[::-1][:4].sum()) < 1e-9
    assert hitmodels.che_time(p, 0) == 0 and hitmodels.che_time(p, 9) == math.inf and hitmodels.lru_hit_ratio(p, 99) == 1
    assert hitmodels.hit_ratio("none", 4, p) == 0 and hitmodels.hit_ratio("random", 4, p) == hitmodels.fifo_hit_ratio(p, 4)


def test_empty_popularity(spark):
    p = hitmodels.Popularity(spark.createDataFrame([], "refs bigint"))
    assert hitmodels.hit_ratios(p, 5) == {"FIFO": 0.0, "LRU": 0.0, "LFU": 0.0}


def brute_counts(ranks, eps, pages, ipp):
    out = np.zeros(pages)
    for r in ranks:
        for e in range(-eps, eps + 1):
            lo, hi = math.floor((r + e - eps) / ipp), math.floor((r + e + eps) / ipp)
            for p in range(max(lo, 0), min(hi, pages - 1) + 1):
                out[p] += 1 / (2 * eps + 1)
    return out


@pytest.mark.parametrize("eps", [0, 1, 8, 30, 60])
def test_page_counts(spark, eps):
    rng = random.Random(eps)
    ipp, n = 16, 170
    pages = -(-n // ipp)
    ranks = [rng.randrange(n) for _ in range(80)]
    df = spark.createDataFrame([(r,) for r in ranks], "pos bigint")
    want = brute_counts(ranks, eps, pages, ipp)
    for got in (costs.page_counts_table(df, [eps], pages, ipp), costs.page_counts_diff(df.withColumn("eps", F.lit(eps)), pages, ipp)):
        have = np.zeros(pages)
        for r in got.collect():
            have[r.page_id] = r.refs
        assert np.allclose(have, want), eps


def test_page_counts_with_mixed_errors(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(170), rng.choice([0, 7, 40])) for _ in range(60)]
    got = {r.page_id: r.refs for r in costs.page_counts_diff(spark.createDataFrame(rows, "pos bigint, eps int"), 11, 16).collect()}
    want = sum(brute_counts([p], e, 11, 16) for p, e in rows)
    assert np.allclose([got.get(i, 0) for i in range(11)], want)


def test_expected_rdac(spark):
    rng = random.Random(2)
    rows = [(a := rng.randrange(200), a + rng.choice([0, 1, 3, 20, 90])) for _ in range(40)]
    df = spark.createDataFrame(rows, "a bigint, b bigint")
    for eps in (0, 1, 6):
        for r in df.select("a", "b", costs.expected_rdac(F.col("a"), F.col("b"), eps, 16).alias("x")).collect():
            v = [1 + (r.b + v + eps) // 16 - max(0, r.a + u - eps) // 16 for u in range(-eps, eps + 1) for v in range(-eps, eps + 1) if v >= u - (r.b - r.a)]
            assert abs(r.x - sum(v) / len(v)) < 1e-9


def test_range_counts_and_union(spark):
    rows = [(0, 3), (2, 2), (5, 9), (9, 9)]
    w = spark.createDataFrame(rows, "page_lo bigint, page_hi bigint")
    got = {r.page_id: r.refs for r in costs.range_page_counts(w, 10).collect()}
    want = {p: sum(a <= p <= b for a, b in rows) for p in range(10)}
    assert got == {p: n for p, n in want.items() if n}
    d = costs.distinct_pages(w).first()
    assert (d.requests, d.distinct_pages) == (sum(want.values()), 9)


def test_covariance_identity(spark):
    rng = random.Random(1)
    rows = [(d := rng.randrange(1, 9), rng.randrange(0, d + 1)) for _ in range(100)]
    r = costs.hit_dac_covariance(spark.createDataFrame(rows, "dac bigint, hits bigint")).first()
    assert r.identity_gap < 1e-9 and abs(r["cov"]) <= r.cov_bound + 1e-9


def test_weighted_quantile(spark):
    df = spark.createDataFrame([(1, 5), (2, 1), (3, 3), (9, 1)], "v bigint, w bigint")
    assert [costs.weighted_quantile(df, "v", "w", q).first().value for q in (0.5, 0.51, 0.9, 1.0)] == [1, 2, 3, 9]
