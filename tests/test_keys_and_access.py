import bisect
import random

import pytest
from pyspark.sql import functions as F

from pagelore.operators import access, joins, keys
from pagelore.operators.predict import Exact

KEYS = sorted(random.Random(3).sample(range(10_000), 1500))
PROBES = [random.Random(4).randrange(-50, 10_100) for _ in range(400)] + [KEYS[0], KEYS[-1], KEYS[700]] * 3


@pytest.fixture(scope="module")
def inner(spark):
    return keys.ranked(spark.createDataFrame([(k,) for k in KEYS + KEYS[:50]], "key bigint")).cache()


@pytest.fixture(scope="module")
def probes(spark):
    return spark.createDataFrame(list(enumerate(PROBES)), "query_idx bigint, key bigint").cache()


def test_ranks(inner):
    assert [(r.key, r.pos, r.page_id) for r in inner.orderBy("key").collect()] == [(k, i, i // 512) for i, k in enumerate(KEYS)]
    f = {r.page_id: r for r in keys.fences(inner).collect()}
    assert (f[1].first_key, f[1].last_key, f[2].n) == (KEYS[512], KEYS[1023], len(KEYS) - 1024)
    assert keys.layout(inner).first().pages == 3


def test_predecessor_and_successor(inner, probes):
    for r in keys.predecessor(probes, inner).collect():
        assert r.pos == max(0, bisect.bisect_right(KEYS, r.key) - 1)
    got = keys.successor(probes, inner).collect()
    assert len(got) == len(PROBES)
    for r in got:
        assert r.pos == bisect.bisect_left(KEYS, r.key)


def test_ranks_of_one_hot_probe(spark, inner):
    hot = spark.range(3000).select(F.col("id").alias("query_idx"), F.lit(KEYS[5]).alias("key"))
    assert keys.predecessor(hot, inner).groupBy("pos").count().collect() == [(5, 3000)]


def test_empty_relations(spark, inner, probes):
    none = spark.createDataFrame([], "key bigint")
    assert keys.ranked(none).count() == 0
    assert keys.predecessor(probes, keys.ranked(none)).agg(F.max("pos")).first()[0] == 0
    assert keys.predecessor(probes.limit(0), inner).count() == 0


@pytest.mark.parametrize("eps", [0, 3, 600])
def test_point_lookup(inner, probes, eps):
    n = len(KEYS)
    pages = [KEYS[i : i + 512] for i in range(0, n, 512)]
    for strategy in ("all_in_once", "one_by_one"):
        for r in access.point_lookup(probes, inner, Exact(inner, eps), strategy).collect():
            pos = max(0, bisect.bisect_right(KEYS, r.key) - 1)
            lo, hi = max(pos - eps, 0) // 512, (min(pos + eps + 2, n) - 1) // 512
            dac = hi - lo + 1
            if strategy == "one_by_one":
                dac = next((i - lo + 1 for i in range(lo, hi + 1) if pages[i][-1] >= r.key), hi - lo + 1)
            assert (r.page_lo, r.page_hi, r.dac, r.found) == (lo, hi, dac, r.key in set(KEYS))


def test_ranges(spark, inner):
    rng = random.Random(5)
    rs = [(i, rng.randrange(-10, 10_050), rng.randrange(-10, 10_050)) for i in range(120)] + [(900, 7, 7), (901, KEYS[9], KEYS[9]), (902, -9, -1)]
    df = spark.createDataFrame(rs, "query_idx bigint, lo bigint, hi bigint")
    want = {i: [k for k in KEYS if min(a, b) <= k <= max(a, b)] for i, a, b in rs}
    assert {r.query_idx: r.matched for r in access.range_counts(df, inner).collect()} == {i: len(v) for i, v in want.items()}
    got = {i: [] for i in want}
    for r in access.range_records(df, inner).collect():
        got[r.query_idx].append(r.key)
    assert {i: sorted(v) for i, v in got.items()} == want


def test_six_modes_agree(spark, inner):
    rng = random.Random(6)
    rows = [(i, rng.choice(KEYS) if rng.random() < 0.7 else rng.randrange(-100, 11_000)) for i in range(700)]
    outer = spark.createDataFrame(rows, "row_id bigint, key bigint")
    parts = spark.createDataFrame([(i, 100, i % 2) for i in range(7)], "part_id bigint, len bigint, is_range tinyint")
    joins.check_partitions(parts, 700)
    want = sorted(r for r in rows if r[1] in set(KEYS))
    for mode in joins.JoinMode:
        got = joins.join(outer, inner, mode, parts)
        assert sorted(map(tuple, got.collect())) == want, mode
        s = joins.join_summary(got, mode).first()
        assert s.matched_records == len(want) and s.checksum == sum(k for _, k in want)
        assert s.record_checksum == (sum(i + 1 for i, _ in want) if mode is joins.JoinMode.HASH else 0)


def test_bad_partitions(spark):
    parts = spark.createDataFrame([(0, 5, 0), (1, 0, 1)], "part_id bigint, len bigint, is_range tinyint")
    with pytest.raises(ValueError):
        joins.check_partitions(parts, 5)


def test_sort_plan_and_modes():
    assert joins.external_sort_plan(100_000, 80_000) == {"runs": 10, "passes": 1, "runs_written": 11}
    assert joins.external_sort_plan(0, 1)["runs"] == 0
    assert joins.JoinMode.parse("sort-merge") is joins.JoinMode.SORTMERGE and not joins.JoinMode.HASH.sorts_outer


def test_sentinels(spark):
    s = keys.SENTINEL
    df = spark.createDataFrame([(1,), (s,), (s,)], "key bigint")
    assert keys.count_sentinels(df).first()[0] == 2
    assert keys.fix_sentinel(df).agg(F.max("key")).first()[0] == s - 1
    r = spark.createDataFrame([(0, 9, 3), (1, 2, s)], "query_idx bigint, lo bigint, hi bigint")
    assert [tuple(x) for x in keys.safe_ranges(r).collect()] == [(0, 3, 9)]


def test_miss_runs(spark):
    f = spark.createDataFrame([(0, 0, 5, False), (0, 1, 6, False), (0, 2, 7, True), (0, 3, 8, False), (1, 0, 1, True)], "query_idx bigint, seq int, page_id bigint, hit boolean")
    assert sorted(map(tuple, access.query_metrics(f).collect())) == [(0, 4, 1, 3, 2), (1, 1, 1, 0, 0)]
