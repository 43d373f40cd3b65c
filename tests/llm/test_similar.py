"""Near duplicates by candidates and the exact check, against all pairs."""

import collections
import random

import numpy as np
import pytest

from pagelore.llm import components, similar
from tests.llm.test_small_tables import DOCS, LONG, docs


def brute(rows, words=5, least=0.8):
    """The smallest id reachable over pairs of at least that Jaccard similarity, of each row."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both >= least * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    ids = collections.defaultdict(list)
    for k, (i, _) in enumerate(rows):
        ids[find(k)].append(i)
    return [min((i for i in ids[find(k)] if i is not None), default=None) for k in range(len(rows))]


def texts(seed, n, bases=5):
    """Copies with a few edits of some base texts, whose similarities lie around 0.8."""
    rng = random.Random(seed)
    base = [[rng.choice("abcdefghijklmnop") + str(rng.randrange(999)) for _ in range(120)] for _ in range(bases)]
    for _ in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5, 9])):
            w[rng.randrange(len(w))] = "edit" + str(rng.randrange(9))
        yield (" ".join(w)).upper() if rng.random() < 0.3 else "\n".join(w)


SPECIAL = [(500, ""), (501, None), (502, " \n"), (503, "one two"), (504, "ONE\ttwo"), (None, "one two"), (505, LONG), (506, LONG + "x"), (507, "one two three four five six"), (507, "alpha beta gamma"), (508, "alpha beta gamma"), (None, "null id alone"), (None, "null id alone")]


@pytest.mark.parametrize(("bucket_cap", "stream", "block"), [(4096, 4096, 64), (4, 3, 2)])
def test_classes_are_those_of_all_pairs(spark, monkeypatch, bucket_cap, stream, block):
    monkeypatch.setattr(similar, "STREAM", stream)
    monkeypatch.setattr(similar, "BLOCK", block)
    if bucket_cap < 4096:  # hot keys apart in every join
        monkeypatch.setattr(similar, "SMALL_ROWS", 0)
        monkeypatch.setattr(components, "SMALL_ROWS", 0)
    rows = [*enumerate(texts(1, 80)), *SPECIAL]
    want = collections.Counter(zip([i for i, _ in rows], brute(rows), strict=True))
    got = similar.similar_documents(docs(spark, [(i, t, "en", "s") for i, t in rows]), bucket_cap=bucket_cap).collect()
    have = collections.Counter((r.id, r.component) for r in got)
    assert have == want
    assert 6 < len({c for _, c in want}) < 60


def test_stars_of_a_wrong_pivot_are_compared_inside(spark):
    """0 is no match of 1 and 2, which match each other: the link is found although all go to pivot 0."""
    rng = np.random.default_rng(5)
    a, b = (np.unique(rng.integers(0, 2**63, 100).astype(np.uint64)) for _ in range(2))
    sets = [(0, a), (1, b), (2, np.sort(np.r_[b[:-3], a[:2]])), (3, np.sort(a[:-1])), (4, b[1:])]
    table = spark.createDataFrame([(n, 7, 7, bytearray(s.astype("<u8").tobytes())) for n, s in sets], "node bigint, fp bigint, fq bigint, shingles binary")
    links = spark.createDataFrame([(0, n) for n in range(1, 5)], "a bigint, b bigint")
    got = {r.node: r.root for r in similar._checked(links, table, 0.8, 28).collect()}
    assert got == {0: 0, 3: 0, 1: 1, 2: 1, 4: 1}


def test_one_of_each(spark):
    rows = [*enumerate(texts(2, 60)), *SPECIAL]
    classes = brute(rows)
    d = spark.createDataFrame([(i, t, None, "s", 0, 1, "k", "f", "i", "t") for i, t in rows], DOCS)
    left = similar.one_of_each(d)
    assert left.columns == d.columns
    want = collections.Counter((i, t) for (i, t), c in zip(rows, classes, strict=True) if c is None or i == c)
    assert collections.Counter((r.doc_id, r.text) for r in left.collect()) == want
    assert (507, "one two three four five six") in want and (508, "alpha beta gamma") not in want
    assert similar.one_of_each(d.limit(0)).count() == 0


def test_clashing_names(spark):
    d = spark.createDataFrame([(1, "x y", 5, 6, 7), (2, "x y", 5, 6, 7)], "id bigint, `a.text` string, row bigint, component int, _may int")
    out = similar.one_of_each(d, id_col="id", text_col="a.text")
    assert out.columns == d.columns and [r.id for r in out.collect()] == [1]
