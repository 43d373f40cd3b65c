"""Columns, types and rows of each opN query on a small table."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op2_line_dedup": {"doc_id": "bigint", "n_lines": "bigint", "n_dropped": "bigint", "kept_sha256": "string"},
    "op3_chat_format": {"conv_id": "bigint", "n_turns": "bigint", "copies": "bigint", "chat": "string"},
    "op4_mix_sources": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op5_simhash_dedup": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op6_token_counts": {"doc_id": "bigint", "n_tokens": "bigint"},
    "op7_bpe_round_trip": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op8_exact_dedup": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op9_nearest_neighbours": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op10_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(spark, name):
    rows = spark.read.parquet(f"{SF}/documents.parquet").count()
    out = entry.queries()[name](spark, SF)
    assert dict(out.dtypes) == COLUMNS[name]
    got = out.collect()
    if "doc_id" in out.columns:
        assert len(got) == rows and len({r.doc_id for r in got}) == rows
    for r in got:
        for c in out.columns:
            if c.endswith("sha256"):
                assert re.fullmatch("[0-9a-f]{64}", r[c])
        if name in ("op1_toxicity", "op10_language_id"):
            assert 0 <= r.score <= 1
        if name == "op1_toxicity":
            assert r.predicted == int(r.score >= 0.5)
        if name == "op5_simhash_dedup":
            assert re.fullmatch("[0-9a-f]{16}", r.fingerprint) and r.component_id <= r.doc_id
    if "held_out" in out.columns:
        import zlib

        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def awkward(spark):
    """Nulls, empty, blank and very long texts, repeated rows; every name that operators use inside, among others."""
    names = ["_c1", "_kept", "_was_null", "_n_lines", "_n_dropped", "score", "id", "row", "source", "size", "_row", "ids", "n_tokens", "label", "root", "a.b", "component", "_may", "fp", "_h", "_src", "_null"]
    rows = [(1, "one two three"), (1, "one two three"), (2, None), (3, ""), (4, " \t\n"), (None, "one two three"), (None, None), (5, "word " * 30_000), (6, "a\nb\na"), (6, "other text")]
    d = spark.createDataFrame([(i, t, "en" if k % 2 else None, "s") for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, lang string, src string")
    return d.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])


@pytest.mark.parametrize("empty", [False, True])
def test_awkward_tables(spark, empty):
    from pagelore.llm import bpe, exact_dedup, language_id, line_dedup, mixing, similar, simhash, token_counts, toxicity

    d = awkward(spark)
    d = d.limit(0) if empty else d
    n = 0 if empty else 10
    labels = spark.createDataFrame([(1, 1), (5, 0)], "doc_id bigint, toxic int")
    scored = toxicity.score(d, toxicity.fit(d, labels))
    assert scored.columns == [c for c in d.columns if c != "score"] + ["score"] and scored.where("score >= 0").count() == n
    lines = line_dedup.dedup_lines(d, min_docs=2, keep_first=True)
    assert lines.columns == d.columns and lines.count() == n and lines.where("text is null").count() == d.where("text is null").count()
    assert line_dedup.with_bitmaps(d, line_dedup.keep_bitmaps(d)).where("_kept is not null").count() == n
    assert mixing.mix(d, source_col="src").count() == n and mixing.mixed(d, source_col="src").columns == d.columns
    assert simhash.near_duplicates(d).count() == n and similar.one_of_each(d).columns == d.columns
    assert similar.one_of_each(d).count() == (0 if empty else 6)
    assert token_counts.count_tokens(d, token_counts.default_path()).count() == n
    out = bpe.encode_checked(d, bpe.default_path())
    assert out.count() == n and out.where("not round_trip").count() == 0 and out.columns == [c for c in d.columns if c not in ("ids", "n_tokens")] + ["ids", "n_tokens", "round_trip"]
    assert exact_dedup.exact_dedup(d, carry=("a.b", "_h")).count() == n
    assert language_id.identify(d, language_id.fit(d)).count() == n


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_stages_on_awkward_tables(spark, empty, tmp_path):
    """Each stage takes nulls, repeated rows, long texts and an empty table, and hands on the columns of documents."""
    import corpus_pipeline as pipeline

    d = awkward(spark).select("doc_id", "text", "lang", F.when(F.col("doc_id") > 2, "s").alias("source"), F.length("text").cast("bigint").alias("n_chars"))
    d = d.limit(0) if empty else d
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, d, SF).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        assert k == 4 or after.columns == d.columns
        d = after
    assert (d.count() == 0) == empty
