"""Findings of reviews: queries against their SQL where tables have several partitions or shapes that small data lack."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def dealt(spark):
    """No small partitions are put together, so every sort has four of them."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield spark
    spark.conf.unset(key)


def differing(spark, name, d=SMALL):
    """(rows of the SQL alone, rows of the query alone)."""
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for f in os.listdir(d):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{d}/{f}'")
    c.sql(f"create table wanted as {entry.oracle_sql()[name]}")
    c.register("arrow_rows", entry.queries()[name](spark, d).toArrow())
    cols = ", ".join(x[0] for x in c.sql("describe wanted").fetchall())
    c.sql(f"create table got as select {cols} from arrow_rows")
    assert c.sql("select count(*) from got").fetchall()[0][0]
    return tuple(c.sql(f"select * from {a} except all select * from {b}").fetchall() for a, b in (("wanted", "got"), ("got", "wanted")))


@pytest.mark.parametrize("name", ["expected_rdac", "page_trace_popularity", "point_lookup_one_by_one", "range_page_counts", "rmi_radix_table_leaves", "rmi_histogram_leaves"])
def test_ranks_of_rows_that_have_ranks(dealt, name):
    """A running total over a union with another running total's rows."""
    assert differing(dealt, name) == ([], [])


@pytest.mark.parametrize("name", ["range_lookup", "range_lookup_matched"])
def test_range_sums_make_no_records(dealt, name, monkeypatch):
    """Ranges hold records by the hundred billion where keys are dense: they are summed up by totals at the ends."""
    from pagelore.operators import access

    monkeypatch.setattr(access, "range_records", lambda *a: pytest.fail("every record was made"))
    assert differing(dealt, name) == ([], [])


def test_range_sums_of_odd_ranges(dealt):
    """Empty, swapped and missing ranges, and several of one query."""
    from pagelore.operators import access

    k = dealt.createDataFrame([(10 * i, i) for i in range(50)], "key bigint, pos bigint")
    r = dealt.createDataFrame([(1, 20, 40), (1, 20, 40), (1, 0, 5), (2, 41, 49), (3, 490, 480), (4, None, None), (5, -9, 9999), (None, 0, 0)], "query_idx bigint, lo bigint, hi bigint")
    got = {x.query_idx: (x.n, x.s) for x in access.range_sums(r, k, {"n": None, "s": "pos"}).collect()}
    assert got == {1: (7, 18), 3: (2, 48 + 49), 5: (50, 1225), None: (1, 0)}


def test_error_stats_of_great_errors(spark):
    """Squares of errors that together pass 2^63."""
    from pyspark.sql import functions as F

    from pagelore.operators import rmi

    leaves = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 3_000_000_000)], "leaf_id int, a double, x0 double, y0 double, err bigint")
    s = rmi.error_stats(rmi.Rmi(lambda c: F.lit(0.0), leaves, 1, 1 << 33), spark.createDataFrame([(1, 0), (2, 1)], "key bigint, pos bigint")).first()
    assert (s.avg_error, s.avg_l2, s.max_error) == (3e9, 9e18, 3_000_000_000)


@pytest.mark.parametrize("policy", ["NONE", "FIFO", "LRU", "LFU"])
def test_runs_of_pages_as_one_by_one(policy):
    import random

    from pagelore.operators.cache import CACHES

    for seed in range(300):
        r = random.Random(seed)
        capacity, pages, longest = r.choice([0, 1, 2, 3, 8]), r.choice([12, 40, 120]), r.choice([3, 20, 90])
        a, b = CACHES[policy](capacity), CACHES[policy](capacity)
        for _ in range(60):
            first, n = r.randrange(pages), r.randrange(1, longest)
            hits = 0
            for p in range(first, first + n):
                hits += a.get(p) or (a.put(p) or 0)
            assert b.run(first, n) == hits
            if policy == "LFU":
                assert a.uses == b.uses and {k: list(v) for k, v in a.by_uses.items() if v} == {k: list(v) for k, v in b.by_uses.items() if v}
            elif policy != "NONE":
                assert list(a.pages) == list(b.pages)


def test_replay_totals_are_those_of_the_replay(dealt):
    from pyspark.sql import functions as F

    from pagelore.operators import access, cache

    w = dealt.range(400).select(F.col("id").alias("query_idx"), (F.col("id") * 37 % 50).alias("page_lo"), (1 + F.col("id") * 11 % 30).alias("dac"))
    cfg = [{"policy": p, "capacity": c, "put_mode": m} for m, c in (("immediate", 8), ("deferred", 3), ("deferred", 0)) for p in cache.CACHES]
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(cache.replay_totals(w, cfg)) == rows(cache.replay_summary(cache.replay(access.page_trace(w), cfg)))


@pytest.mark.parametrize("name", ["range_bench"])
def test_totals_need_no_row_for_a_request(dealt, name, monkeypatch):
    from pagelore.operators import access

    monkeypatch.setattr(access, "page_trace", lambda *a: pytest.fail("every request was made a row"))
    assert differing(dealt, name) == ([], [])


def test_rmi_benchmark_needs_no_row_for_a_request(dealt, monkeypatch):
    from pagelore.operators import access

    monkeypatch.setattr(access, "page_trace", lambda *a: pytest.fail("every request was made a row"))
    assert entry.queries()["rmi_benchmark"](dealt, SMALL).count() == 9


def test_nothing_to_choose_from(dealt):
    """No index fits, or none leaves a page for the cache."""
    from pagelore.operators import tune

    r = dealt.range(100).withColumnRenamed("id", "pos")
    for n, memory, fits in ((1 << 20, 4096, False), (100, 4096, True)):
        rows = tune.choose_epsilon(r, n, [16, 64], memory, policy="LFU").collect()
        assert [(x.feasible, x.cost, x.chosen) for x in rows] == [(fits, None, None)] * 2
    assert [x.chosen for x in tune.choose_epsilon(r, 100, [16, 64], 1 << 20, policy="LFU").orderBy("eps").collect()] == [True, False]


def test_sampled_estimates_without_room(dealt):
    """Where the index leaves no page for the cache a lookup costs all the pages it asks for, and keeps its row."""
    from pagelore.plans import file_queries
    from pagelore.plans import inputs as I

    k, p = I.events_keys(dealt, SMALL), I.event_probes(dealt, SMALL)
    rows = file_queries.sampled_estimates(p, k, [10, 100], [16, 64], [4096], ("FIFO", "LRU", "LFU")).collect()
    assert sorted((r.rate, r.eps, r.cache_pages, r.hit_ratio, r.cost, r.estimated_total_ios) for r in rows) == [(rate, eps, 0, 0.0, cost, 1000 * cost) for rate in (10.0, 100.0) for eps, cost in ((16, 1.0625), (64, 1.25)) for _ in range(3)]
    assert differing(dealt, "sampled_estimate_sweep") == ([], [])


def test_range_bench_predicts_by_an_index(dealt):
    """Windows come from segments built over the keys, as a plain build and search give them, not from the keys' ranks."""
    import numpy as np

    from pagelore.operators import pgm

    ts = duckdb.sql(f"select event_id, epoch_us(ts) from '{SMALL}/events.parquet'").fetchall()
    keys = sorted({t for _, t in ts})
    n, seg = len(keys), list(pgm.segment(keys, range(len(keys)), 64, len(keys)))
    rows = [(s[0], float(np.float32(s[2])), s[3], nxt) for s, nxt in zip(seg, [*[s[3] for s in seg[1:]], n], strict=True)]
    lo, hi = (np.array([t + h * (i * 7919 % 97) * 600_000_000 for i, t in ts]) for h in (0, 1))
    total = lambda a, b: int(((np.minimum(b + 66, n) - 1) // 512 - np.maximum(a - 64, 0) // 512 + 1).sum())
    want = total(*(pgm.predict(rows, x) for x in (lo, hi)))
    assert want != total(*(np.searchsorted(keys, x, "right") - 1 for x in (lo, hi)))
    assert {r.total_dac for r in entry.queries()["range_bench"](dealt, SMALL).collect()} == {want}


@pytest.mark.parametrize("shape", ["missing times", "one key", "bursts"])
def test_range_bench_of_odd_tables(dealt, tmp_path, shape):
    """bursts: a thousand keys within a millisecond each hour, so that segments end often and lines are steep."""
    ts = {"missing times": "case when event_id % 7 > 0 then ts end", "one key": "timestamp '2024-01-01'", "bursts": "timestamp '2024-01-01' + to_microseconds((event_id // 1000) * 3600000000 + event_id % 1000)"}[shape]
    many = "from range(6000) t(event_id)" if shape == "bursts" else f"from '{SMALL}/events.parquet'"
    duckdb.sql(f"copy (select event_id, ({ts})::timestamp as ts {many}) to '{tmp_path}/events.parquet'")
    assert differing(dealt, "range_bench", str(tmp_path)) == ([], [])
