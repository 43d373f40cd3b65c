import bisect
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagelore.operators import join_cost, keys, pgm, report, rmi, tune, workload
from pagelore.operators.predict import Pgm


def fits(points, eps):
    return all((v + eps - (y - eps)) * (b - a) >= (q - eps - (p + eps)) * (u - x) for i, (x, y) in enumerate(points) for u, v in points[i + 1 :] for j, (a, p) in enumerate(points) for b, q in points[j + 1 :])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3000), min_size=1, max_size=14, unique=True), st.integers(0, 3))
def test_segments_are_greedy_and_bounded(values, eps):
    ks = sorted(values)
    n = len(ks)
    segs = list(pgm.segment(ks, range(n), eps, n))
    points, want, at = [*zip(ks, range(n), strict=True), (ks[-1] + 1, n)], 0, 0
    while at < len(points):
        end = at + 1
        while end < len(points) and fits(points[at : end + 1], eps):
            end += 1
        want, at = want + 1, end
    assert len(segs) == want
    for k, r in zip(ks, range(n), strict=True):
        s = [x for x in segs if x[0] <= k][-1]
        assert -eps - 2 < r - (int(s[2] * (k - s[0])) + s[3]) + 0 and int(s[2] * (k - s[0])) + s[3] - eps <= r < int(s[2] * (k - s[0])) + s[3] + eps + 2


@pytest.mark.parametrize("ks", [[], [5], [5, 6], [7, 7, 7, 9], list(range(2000)), [i * i for i in range(1500)], [2**63 - 4, 2**63 - 3, 2**63 - 2]])
def test_segment_fixtures(ks):
    segs = list(pgm.segment(ks, range(len(ks)), 4, len(ks)))
    assert bool(segs) == bool(ks)
    if ks == list(range(2000)):
        assert len(segs) == 1


@pytest.fixture(scope="module")
def inner(spark):
    ks = sorted(random.Random(8).sample(range(10**15, 10**15 + 10**11), 6000))
    return keys.ranked(spark.createDataFrame([(k,) for k in ks], "key bigint")).cache()


@pytest.mark.parametrize("chunk", [1 << 20, 1000])
def test_pgm_windows_hold_every_key(spark, inner, chunk):
    segs = pgm.build(inner, 16, chunk=chunk)
    probes = inner.select(F.col("pos").alias("query_idx"), "key").unionByName(spark.createDataFrame([(-1, 0), (-2, 2 * 10**15)], "query_idx bigint, key bigint"))
    w = Pgm(inner, segs, 16).windows(probes).join(inner.select("key", "pos", "page_id"), "key", "left")
    assert w.count() == 6002
    assert w.where(F.col("page_id").isNotNull() & ~F.col("page_id").between(F.col("page_lo"), F.col("page_hi"))).count() == 0
    assert w.where("pos is not null and (pos < pred - 16 or pos >= pred + 18)").count() == 0
    s = pgm.sizes(segs).first()
    assert s.size_in_bytes == 16 * segs.count() + 8 * s.height and s.segments_count >= (6 if chunk == 1000 else 1)


def test_models_match_golden_values(spark):
    def at(kind, pts, *xs):
        f = rmi.fit(spark.createDataFrame(pts, "key bigint, pos bigint"), kind)
        return list(spark.range(1).select(*[f(F.lit(float(x))).cast("double").alias(f"x{i}") for i, x in enumerate(xs)]).first())

    assert np.allclose(at("linear", [(1, 2), (2, 3), (3, 4)], 1, 6), [2, 7])
    assert np.allclose(at("linear", [(1, 2)], 1), [2])
    assert [int(x) for x in at("loglinear", [(2, 2), (3, 4), (4, 16)], 2, 4)] == [1, 13]
    assert np.allclose(at("linear_spline", [(1, 2), (2, 3), (3, 8)], 1, 3), [2, 8])
    assert np.allclose(at("cubic", [(1, 2), (2, 3), (3, 8), (4, 20)], 1, 4), [2, 20], atol=0.5)
    assert np.allclose(at("cubic", [(1, 2), (2, 3), (3, 8), (4, 20), (5, 80)], 1, 5), [2, 80], atol=0.5)
    assert np.allclose(at("cubic", [(1, 2), (1, 2), (1, 2)], 1), [2])
    assert [int(x) for x in at("normal", [(1, 1), (2, 3), (3, 5)], 2, 1)] == [2, 0]
    assert int(at("lognormal", [(1, 1), (2, 2), (3, 20)], 2)[0]) == 11
    assert rmi.common_prefix_bits(1, 8) == 60 == rmi.common_prefix_bits(1, 12)


@pytest.mark.parametrize("top", ["linear", "linear_spline", "robust_linear", "cubic", "normal", "radix", "histogram"])
def test_rmi_covers_its_keys_and_gaps(spark, inner, top):
    m = rmi.train(inner, top, "linear", 16)
    p = m.predict(inner.select("key", "pos"))
    assert p.where("abs(pred - pos) > err").count() == 0
    with pytest.raises(ValueError):
        rmi.train(inner, "linear", "radix", 16)


def test_pareto(spark):
    rows = [(10, 5.0), (20, 4.0), (30, 4.0), (15, 6.0), (40, 1.0), (10, 5.0)]
    front = rmi.pareto_front(spark.createDataFrame(rows, "size bigint, avg_log2 double"))
    assert sorted(map(tuple, front.collect())) == [(10, 5.0), (10, 5.0), (20, 4.0), (40, 1.0)]
    kept = rmi.narrow([{"size": s, "avg_log2": e} for s, e in [(10, 5.0), (11, 4.0), (40, 1.0)]], 2)
    assert [r["size"] for r in kept] == [40, 11]
    assert rmi.smallest_error_below(kept, 40)["size"] == 11


def test_line_spline():
    ks = sorted(random.Random(3).sample(range(100_000), 500))
    knots = rmi.line_spline(ks, range(500), 8)
    xs = [k for k, _ in knots]
    for k, r in zip(ks, range(500), strict=True):
        i = max(0, min(len(knots) - 2, bisect.bisect_right(xs, k) - 1))
        (x0, y0), (x1, y1) = knots[i], knots[i + 1]
        assert int(y0 + (y1 - y0) * (k - x0) / (x1 - x0) + 1e-9) // 8 == r // 8


def test_partitioner(spark, inner):
    rng = random.Random(4)
    ks = [r.key for r in inner.collect()]
    rows = [(i, rng.choice(ks[: 500 if i % 3 else 6000])) for i in range(3000)]
    probes = spark.createDataFrame(rows, "query_idx bigint, key bigint")
    cost = join_cost.JoinCost(n_min=100, k_max=6)
    for chunk in (join_cost.CHUNK, 700):
        parts = join_cost.partition_probes(probes, inner, 16, cost, chunk).orderBy("part_id").collect()
        assert sum(p.len for p in parts) == 3000 and [p.start for p in parts] == list(np.cumsum([0, *[p.len for p in parts]])[:-1])
        for p in parts:
            assert p.is_range == int(cost.prefers_range(p.len, p.span, p.pages))


def test_cost_fits(spark):
    rows = [(n, 0.01 * k + 2e-3 * n + 0.5, 0.01 * k, k) for n, k in [(10, 5), (20, 9), (40, 7), (80, 3), (160, 6)]]
    f = join_cost.fit_point(spark.createDataFrame(rows, "num_queries bigint, total_wall_time_s double, IO_time_s double, IOs bigint")).first()
    assert np.allclose([f.alpha, f.delta, f.lambda_point], [2e-3, 0.5, 0.01])


def test_workloads_are_repeatable(spark, inner):
    a = workload.mixture_positions(spark, 900, 6000, workload.MIXTURES["w4"])
    rows = sorted(map(tuple, a.collect()))
    assert rows == sorted(map(tuple, workload.mixture_positions(spark, 900, 6000, workload.MIXTURES["w4"]).collect()))
    assert [i for i, _ in rows] == list(range(900)) and all(0 <= p < 6000 for _, p in rows)
    w = workload.windowed_positions(spark, 1000, 6000, (0.4, 0.3, 0.3), 7)
    assert sorted(r.query_idx for r in w.collect()) == list(range(1000))
    c = workload.allocate_windows(1000, 7, (0.4, 0.3, 0.3), 0.1, 1)
    assert c.sum(axis=0).tolist() == [400, 300, 300] and c.sum() == 1000 and c.min() >= 0
    u = workload.unique_sample(a, 50, strict=True)
    assert u.select("pos").distinct().count() == 50
    with pytest.raises(ValueError):
        workload.mixture_positions(spark, 10, 10, (0.5, 0.2, 0.2))
    r = workload.range_workload(a, 6000, 1, 64).collect()
    assert all(x.rank_lo <= x.rank_hi < min(6000, x.rank_lo + 64) for x in r)


def test_tuners(spark, inner):
    law = tune.fit_power_law({e: int(5000 * e**-1.5 + 40) for e in (2, 4, 8, 16, 32)})
    assert all(abs(law(e) / (5000 * e**-1.5 + 40) - 1) < 0.01 for e in (2, 5, 8, 32))
    assert tune.fit_power_law({})(7) == 0 and tune.fit_power_law({4: 9})(100) == 9 == tune.fit_power_law({4: 9, 0: 3})(1)
    sizes = {e: 20_000 // e for e in range(1, 5000)}
    eps, _ = tune.tune_for_space(inner, 500, 2, 4096, tolerance=0, measure=sizes.get)
    assert sizes[eps] <= 500 < sizes[eps - 1]
    assert tune.tune_for_time(lambda e: 10 * e, 1000, 2, 4096) == 100


def test_residual_models(spark):
    rng = random.Random(1)
    rows = [(float(rng.choice([8, 16, 32])), float(rng.choice([1, 2, 4])), rng.random()) for _ in range(60)]
    df = spark.createDataFrame(rows, "epsilon double, M double, est double").withColumn("act", F.col("est") + 0.3 + 0.02 * F.col("epsilon") - 0.1 * F.col("M"))
    f = tune.residual_features()
    w = tune.fit_residuals(df, "act", "est", f)
    after = tune.error_summary(tune.correct(df, "est", f, w, clip=False), "act", "corrected").first()
    assert after.mae < 1e-8
    assert all(r["mae_after"] < 1e-6 < r["mae_before"] for r in tune.holdout_by_memory(df, "act", "est", [F.lit(1.0), F.col("epsilon"), F.col("M")]) if r["mae_before"] > 1e-6)
    wt, b = tune.fit_ridge_standardized(df.withColumn("r", F.col("act") - F.col("est")), {"e": F.col("epsilon"), "m": F.col("M")}, "r", 0.0)
    assert np.allclose([*wt, b], [0.02, -0.1, 0.3])


def test_reports(spark):
    df = spark.createDataFrame([("a", 1, "x", 2.0), ("a", 2, "x", 4.0), ("b", 1, "y", 1.0), ("b", 2, "z", 3.0), ("b", 2, "z", 5.0)], "g string, M int, s string, v double")
    r = {x.g: x for x in report.aggregate_repeats(df, ["g"], ["M"]).collect()}
    assert (r["a"].s, r["b"].s, r["a"].M, r["b"].M, r["b"].v_mean, r["b"].repeats) == ("x", "varies", 1, 2, 3.0, 3)
    with pytest.raises(ValueError):
        report.require_unique(df, ["g"])
    assert report.missing_combinations(df, {"g": ["a", "b"], "M": [1, 2, 3]}).count() == 2
    p = report.percentiles(df, "v", (50, 99)).first()
    assert (p.p50, p.p99) == (3.0, 5.0)
    with pytest.raises(ValueError):
        report.latency_parts(spark.createDataFrame([(2.0, 1.0)], "a double, wall double"), ["a"], "wall")
    f = report.merge_filled(spark.createDataFrame([(1, 1), (1, 2)], "g int, k int"), spark.createDataFrame([(1, 2, 7.0)], "g int, k int, v double"), ["g", "k"], {"v": ["g"]})
    assert [x.v for x in f.collect()] == [7.0, 7.0]
    s = report.state_space_rows(df.select("g", "M", "v").limit(1), df.select("g", "M", F.lit(0.0).alias("v")).limit(1), ["g", "M"], ["v"]).first()
    assert np.isnan(s.rel_v)


def test_key_files(spark, tmp_path):
    from pagelore.sources import keyfile, records

    keyfile.register(spark)
    ks = sorted(random.Random(1).sample(range(2**60), 3000))
    (tmp_path / "a.bin").write_bytes(len(ks).to_bytes(8, "little") + np.array(ks, "<u8").tobytes())
    read = lambda p, **o: sorted(map(tuple, spark.read.format("keyfile").options(**o).load(str(p)).collect()))
    assert read(tmp_path / "a.bin", split=4096) == list(enumerate(ks))
    assert read(tmp_path / "a.bin", limit=7) == list(enumerate(ks[:7]))
    assert len(read(tmp_path / "a.bin", header="no")) == 3001
    with pytest.raises(Exception, match="expected"):
        read(tmp_path / "a.bin", header="yes", count=5)
    (tmp_path / "r.bin").write_bytes(np.array([9, 4, 2**64 - 1, 5, 1, 2], "<u8").tobytes())
    assert read(tmp_path / "r.bin", kind="ranges", header="no", fix_sentinel="true") == [(0, 4, 9), (2, 1, 2)]
    (tmp_path / "u.bin").write_bytes(np.array([0, 2**63, 2**64 - 1], "<u8").tobytes())
    assert [k for _, k in read(tmp_path / "u.bin", header="no", flip_sign="true")] == [-(2**63), 0, 2**63 - 1]
    (tmp_path / "f.bin").write_bytes(np.array([0.5, 2.0], "<f8").tobytes())
    assert read(tmp_path / "f.bin", dtype="float64", header="no") == [(0, 0.5), (1, 2.0)]
    (tmp_path / "p.par").write_bytes(np.array([3, 4], "<u8").tobytes())
    (tmp_path / "p.bitmap").write_bytes(bytes([0, 1]))
    assert sorted(map(tuple, keyfile.load_partitions(spark, str(tmp_path / "p.par"), str(tmp_path / "p.bitmap")).collect())) == [(0, 3, 0), (1, 4, 1)]
    out = spark.createDataFrame([(k,) for k in ks], "key bigint").repartitionByRange(3, "key").sortWithinPartitions("key")
    out.write.format("keyfile").mode("append").option("header", "yes").save(str(tmp_path / "out"))
    assert read(tmp_path / "out", header="auto") == list(enumerate(ks))
    (tmp_path / "rec.csv").write_text("#name,m\n#branch_factor,64\ntrue_pos,leaf_id,err,pred_pos,key\n1,0,2,3,9\n")
    assert [tuple(r) for r in records.rmi_records(spark, str(tmp_path / "rec.csv")).collect()] == [(1, 0, 2, 3, 9)]
    assert dict(map(tuple, records.rmi_metadata(spark, str(tmp_path / "rec.csv")).collect())) == {"name": "m", "branch_factor": "64"}
    (tmp_path / "grid.json").write_text('{"configs":[{"layers":"linear,linear","branching factor":64,"namespace":"a","size":9,"average log2 error":1.5,"binary":true},{"layers":"x","branching factor":0,"namespace":"b","size":1,"average log2 error":2.0,"binary":true}]}')
    assert [r.branch_factor for r in records.optimizer_configs(spark, str(tmp_path / "grid.json")).collect()] == [64]


def test_stream_monitor(spark, tmp_path):
    from pagelore.streaming import monitor

    for i in range(2):
        spark.createDataFrame([("g", f"2024-01-01 00:0{i}:0{j}", p) for j, p in enumerate([1, 2, 1, 3] if i == 0 else [3, 1])], "group string, t string, page_id bigint").select("group", F.to_timestamp("t").alias("ts"), "page_id").coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/b={i}"))
    src = spark.readStream.schema("group string, ts timestamp, page_id bigint").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/b=*"))
    q = monitor.with_hits(src, 2).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("ts").collect()
    assert len(rows) == 6 and rows[2].hit and not rows[3].hit
    w = monitor.hit_ratio_windows(spark.read.parquet(str(tmp_path / "out"))).first()
    assert w.requests == 6


def test_registry():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) > 80
