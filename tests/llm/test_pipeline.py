"""Each stage of the pipeline against a plain version on its own input, and the whole on a small table."""

import collections

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from pagelore.llm import bpe, mixing
from tests.llm.test_similar import brute
from tests.llm.test_small_tables import brute_lines

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows before the first stage and after each."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("pipeline") / name)
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def rows(df):
    return collections.Counter(map(tuple, df.collect()))


def test_columns_stay(stages):
    assert [len(pipeline.STAGES), *[n for n, _ in pipeline.STAGES]] == [5, "toxicity", "line_dedup", "simhash_dedup", "mixing", "bpe_encoding"]
    assert all(s.columns == stages[0].columns for s in stages[:5])


def test_toxic_documents_go_whole(stages):
    before, after = rows(stages[0]), rows(stages[1])
    assert not after - before and sum(after.values()) > 0.7 * sum(before.values())


def test_lines(stages):
    before = [(r.doc_id, r.text) for r in stages[1].collect()]
    want = brute_lines(before, 2, 20, True)
    for r in stages[2].collect():
        i, t = next((i, t) for i, t in before if i == r.doc_id)
        assert r.text == want[i, t][2] and r.n_chars == len(r.text)
    assert stages[2].count() == len(before)


def test_one_of_each_class(stages):
    r = stages[2].collect()
    classes = brute([(x.doc_id, x.text) for x in r])
    assert rows(stages[3]) == collections.Counter(tuple(x) for x, c in zip(r, classes, strict=True) if x.doc_id == c)


def test_mix(stages):
    copies = {r.doc_id: r.copies for r in mixing.mix(stages[3]).collect()}
    assert rows(stages[4]) == collections.Counter({tuple(r): copies[r.doc_id] for r in stages[3].collect() if copies[r.doc_id]})


def test_tokens(stages):
    lib = Tokenizer.from_file(bpe.default_path())
    texts = {r.doc_id: r.text for r in stages[4].collect()}
    got = stages[5].collect()
    assert len(got) == stages[4].count()
    for r in got:
        assert r.round_trip and np.frombuffer(r.ids, "<u4").tolist() == lib.encode(texts[r.doc_id], add_special_tokens=False).ids and 4 * r.n_tokens == len(r.ids)


def test_run(spark, stages):
    assert pipeline.ORACLE_SQL is None
    assert rows(pipeline.run(spark, SF)) == rows(stages[5])
