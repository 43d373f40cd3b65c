"""Cuts that a review found, each against a plain version."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from pagelore.llm import line_dedup, nearest
from tests.llm.test_small_tables import brute_lines, docs


@pytest.mark.parametrize("batch", [1, 2, 3])
@pytest.mark.parametrize("rule", [dict(min_docs=3, min_chars=1, keep_first=False), dict(min_docs=2, min_chars=1, keep_first=True)])
def test_line_runs_that_end_with_a_batch(spark, rule, batch):
    rows = [(i, "\n".join([f"own {i}", *(f"shared by {n}" for n in range(1, 7) if i % 6 < n)])) for i in range(18)] + [(None, "own 3\nshared by 1")]
    want = brute_lines(rows, **rule)
    d = docs(spark, [(i, t, "en", "s") for i, t in rows])
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = line_dedup.with_bitmaps(d, line_dedup.keep_bitmaps(d, **rule)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    have = collections.Counter((r.doc_id, r._n_lines, r._n_dropped, r._kept) for r in got)
    assert have == collections.Counter((i, *want[i, t]) for i, t in rows)


def test_pipeline_drops_repeats_of_documents_that_are_mostly_repeats(spark):
    shared = [f"passage number {n} that many documents share" for n in range(9)]
    rows = [(i, "\n".join([*shared[: 1 + i % 9], f"this line is document {i}'s own", *["short"] * (i % 3)])) for i in range(20)] + [(50, "\n".join(shared))]
    want = brute_lines(rows, 2, 20, True)
    out = pipeline.drop_repeated_lines(spark, docs(spark, [(i, t, "en", "s") for i, t in rows]).withColumn("n_chars", F.lit(0).cast("bigint")), None).collect()
    assert {(r.doc_id, r.text, r.n_chars) for r in out} == {(i, want[i, t][2], len(want[i, t][2])) for i, t in rows} and len(out) == len(rows)
    assert sum("passage number" in x for r in out for x in r.text.split("\n")) == len(shared)


def test_nearest_of_many_collinear_vectors(spark):
    rng = np.random.default_rng(4)
    base, other = rng.normal(size=8).astype(np.float32), rng.normal(size=(200, 8)).astype(np.float32)
    ids = rng.permutation(100).tolist()
    rows = [(ids[i], (base * np.float32(2.0 ** (i - 50))).tolist()) for i in range(100)] + [(1000 + i, x.tolist()) for i, x in enumerate(other)]
    d = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = collections.defaultdict(list)
    for shard_rows in (1000, 90):
        got.clear()
        for r in nearest.nearest(d, d.where("vec_id in (0, 57, 99)"), k=5, shard_rows=shard_rows).orderBy("query_id", "rank").collect():
            got[r.query_id].append(r.vec_id)
        assert got == {0: [1, 2, 3, 4, 5], 57: [0, 1, 2, 3, 4], 99: [0, 1, 2, 3, 4]}
