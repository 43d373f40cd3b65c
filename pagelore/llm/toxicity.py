"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in NumPy.

A word is the bag of its character n-grams and of itself, hashed into 2^BITS buckets; its vector is the mean
of their embeddings, a passage's vector the mean of its words', and a linear layer with softmax gives the
probabilities. Misspellings that were never seen share n-gram vectors with the words that were. Embeddings
and layer are trained together, with Adagrad, on a bounded sample of labelled documents of both classes.

A long document with few toxic words would average them away, so whole texts are scored in passages of
WINDOW words, each word in one of them and in one of a second row shifted by half; the text's score is that of
its most toxic passage. Training follows the same rule: the passage that counts is the one that now scores
highest. As everything before the softmax is linear, a word's share of the logits is computed once per
worker and looked up for each further occurrence.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from pagelore.llm.common import give_back, held_out, named, positional, trimmed
from pagelore.llm.ngrams import WordRows, in_groups, ngram_buckets, per_word_sums
from pagelore.runtime import stored, table

BITS, SIZES, DIM, WINDOW = 18, range(3, 6), 8, 64
#: The classifier is fitted on at most this many labelled documents of each class, in hash order.
SAMPLE_ROWS = 2000
TRAIN = {"prior": 0.2, "epochs": 5, "rate": 0.2, "l2": 1e-5, "batch": 16, "min_docs": 8, "seed": 11}


_TOKEN = re.compile(r"\w*[^\W\d_]\w*").findall


def tokens_of(text: str | None) -> list[str]:
    """Lower-cased runs of word characters with a letter in them: digits and underscores put into a word
    leave it one word, which keeps the n-grams around them."""
    return _TOKEN(text.lower()) if text else []


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket), sorted by word: the n-grams of <word> and the word as a whole."""
    at, bucket = ngram_buckets(words, SIZES, BITS)
    h = np.fromiter((int.from_bytes(w.encode()[:7] + bytes([len(w) & 255]), "little") for w in words), np.uint64, len(words))
    whole = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)
    at, bucket = np.r_[at, np.arange(len(words))], np.r_[bucket, whole]
    order = np.argsort(at, kind="stable")
    return at[order], bucket[order]


def passage_rows(n: int, window: int) -> list[np.ndarray]:
    """The passage of each of n words: every window, then, if there are several, those shifted by half.
    The last, shorter passage of a row belongs to the one before it."""
    at, last = np.arange(n), max(0, n // window - 1)
    rows = [np.minimum(at // window, last)]
    if last:
        rows.append(np.minimum((at + window // 2) // window, (n + window // 2) // window - 1))
    return rows


def passage_sums(ids: np.ndarray, values: np.ndarray, window: int):
    """For each row of passages: (passage of each word, which words count, words of each passage, mean
    value of each passage). A word counts once in a passage, so that one word said over and over
    doesn't make a passage; the mean is over all its words."""
    for p in passage_rows(len(ids), window):
        _, first = np.unique(p * (int(ids.max()) + 1) + ids, return_index=True)
        n = np.bincount(p)
        yield p, first, n, np.bincount(p[first], weights=values[first], minlength=len(n)) / n


class Model:
    """Two-class model. Without training data every text scores 0."""

    def __init__(self, embed=None, layer=None, bias=None, window: int = WINDOW):
        self.uid, self.window, self.margin, self.scale, self.shift = uuid.uuid4().hex, window, None, 1.0, 0.0
        if embed is not None:
            self.margin, self.bias = embed @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0])

    def _make(self, words):
        at, bucket = subwords(words)
        n = np.bincount(at, minlength=len(words))
        return (per_word_sums(at, self.margin[bucket], len(words)) / n)[:, None]

    def scores(self, texts) -> list[float]:
        """Of each text the probability of the toxic class for its most toxic passage; 0 without a
        model, and for a text without words."""
        if self.margin is None:
            return [0.0 for _ in texts]
        words = WordRows.of_model(self.uid, self._make, 1)
        out = []
        for sizes, flat in in_groups(texts, split=tokens_of):
            ids = words.numbers(flat) if flat else np.zeros(0, np.int64)
            s = words.rows[ids, 0]
            at = 0
            for n in sizes:
                best = -np.inf
                if n:
                    best = max(float(m.max()) for *_, m in passage_sums(ids[at : at + n], s[at : at + n], self.window))
                out.append(best + self.bias)
                at += n
        odds = np.array(out)
        return np.where(np.isinf(odds), 0.0, 1 / (1 + np.exp(-np.clip(self.scale * odds + self.shift, -50, 50)))).tolist()


def calibrate(model: Model, texts: list[str], labels: np.ndarray, prior: float) -> None:
    """Logistic scale and shift of the model's margin on documents that it was not fitted on, weighted
    so that the toxic class has the share ``prior``; a ridge keeps both finite if the classes part."""
    if not len(labels) or labels.min() == labels.max():
        return
    p = np.clip(np.array(model.scores(texts)), 1e-12, 1 - 1e-12)
    x = np.c_[np.log(p / (1 - p)), np.ones(len(p))]
    w = np.where(labels == 1, prior / labels.mean(), (1 - prior) / (1 - labels.mean()))
    at, start, ridge = np.array([1.0, 0.0]), np.array([1.0, 0.0]), np.diag([0.5, 0.05])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ at, -50, 50)))
        step = np.linalg.solve((x * (w * q * (1 - q))[:, None]).T @ x + ridge, x.T @ (w * (q - labels)) + ridge @ (at - start))
        at = at - np.clip(step, -1, 1)
        at[0] = max(at[0], 0.05)
    model.scale, model.shift = float(at[0]), float(at[1])


def train(texts: list[str], labels: np.ndarray, prior: float = 0.2, window: int = WINDOW, epochs: int = 5, rate: float = 0.2, l2: float = 1e-5, batch: int = 16, min_docs: int = 8, seed: int = 11, bias_rate: float = 0.02) -> Model:
    """Fits embeddings and layer by Adagrad on four fifths of the documents; the others calibrate the
    scores for a toxic share of ``prior``. Buckets of fewer than min_docs documents keep the zero vector."""
    if not len(labels) or labels.min() == labels.max():
        return Model()
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.1, (1 << BITS, DIM))
    # The bias starts against the toxic class: words must speak for it, their absence must not.
    layer, bias = rng.normal(0, 0.5, (DIM, 2)), np.array([1.0, -1.0])
    ge, gl, gb = np.full(1 << BITS, 1e-6), np.full((DIM, 2), 1e-6), np.full(2, 1.0)
    held = np.arange(len(labels)) % 5 == 4
    docs = [tokens_of(t) for t in texts]
    keep = [i for i, w in enumerate(docs) if w and not held[i]]
    # Buckets of few documents would be learned by heart: they keep the zero vector.
    df = np.zeros(1 << BITS, np.int64)
    for i in keep:
        df[np.unique(subwords(list(dict.fromkeys(docs[i])))[1])] += 1
    rare = df < min_docs
    embed[rare] = 0
    for epoch in range(epochs):
        order = rng.permutation(keep)
        for first in range(0, len(order), batch):
            picked = []
            margin = layer[:, 1] - layer[:, 0]
            for i in order[first : first + batch]:
                w = docs[i]
                own = list(dict.fromkeys(w))
                at, bucket = subwords(own)
                mean = per_word_sums(at, embed[bucket], len(own)) / np.bincount(at)[:, None]
                number = dict(zip(own, range(len(own)), strict=True))
                ids = np.fromiter(map(number.__getitem__, w), np.int64, len(w))
                p, first_of, n, m = max(passage_sums(ids, (mean @ margin)[ids], window), key=lambda r: r[3].max())
                k = int(m.argmax())
                uses = np.bincount(ids[first_of[p[first_of] == k]], minlength=len(own)) / n[k]
                picked.append((at, bucket, uses, uses @ mean, labels[i]))
            v = np.array([p[3] for p in picked])
            x = v @ layer + bias
            x = np.exp(x - x.max(axis=1, keepdims=True))
            x /= x.sum(axis=1, keepdims=True)
            y = np.array([p[4] for p in picked])
            x[np.arange(len(y)), y] -= 1
            x /= len(y)
            dv = x @ layer.T
            grads_b, grads_v = [], []
            for (at, bucket, uses, _, _), d in zip(picked, dv, strict=True):
                share = (uses / np.bincount(at))[at]
                used = (share > 0) & ~rare[bucket]
                grads_b.append(bucket[used])
                grads_v.append(share[used, None] * d[None, :])
            cells, where = np.unique(np.concatenate(grads_b), return_inverse=True)
            g = np.zeros((len(cells), DIM))
            np.add.at(g, where, np.concatenate(grads_v))
            g += l2 * embed[cells]
            ge[cells] += (g * g).mean(axis=1)
            dl = v.T @ x
            gl += dl * dl
            embed[cells] -= rate * g / np.sqrt(ge[cells])[:, None]
            layer -= 0.2 * dl / np.sqrt(gl)
            db = x.sum(axis=0)
            gb += db * db
            bias -= bias_rate * db / np.sqrt(gb)
    model = Model(embed, layer, bias, window)
    calibrate(model, [t for t, h in zip(texts, held, strict=True) if h], labels[held], prior)
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, **setup) -> Model:
    """A model of the labelled rows: about sample_rows documents of either class, three times as many at most
    in all. Labels other than
    0 and 1, null ids and labels without a document are passed over; of contradictory labels of one
    id, 1 holds. Ids are picked by hash from the labels alone, so texts are read once, for the picked."""
    own = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    own = stored(own, "labels")
    n = {r.y: r.n for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return Model(window=setup.get("window", WINDOW))
    h = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 40)).cast("double") / float(1 << 40)
    limit = F.when(F.col("y") == 1, min(1.0, sample_rows / n[1])).otherwise(min(1.0, sample_rows / n[0]))
    picked = own.where(h <= limit).withColumn("h", h).orderBy("h", "id").limit(3 * sample_rows)  # a bounded number of (id, y)
    got = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id").orderBy("h", "id", "text").limit(3 * sample_rows).collect()
    model = train([r.text or "" for r in got], np.array([r.y for r in got], dtype=int), **TRAIN | setup)
    del got
    give_back()
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs + score: every whole text's probability of being toxic, from its text alone. Null
    texts and those without a letter score 0. Every row stays, repeated ones as often as they are there, equal
    texts with equal scores; an empty table gives an empty one. A column named score is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS doubles
    src, at = positional(docs), docs.columns.index(text_col)

    def run(batches):
        m = shared.value
        for b in batches:
            s = pa.array(m.scores(b.column(at).to_pylist()), pa.float64())
            yield pa.record_batch([*b.columns, s], schema=pa.schema([*b.schema, ("_score", pa.float64())]))

    out = src.mapInArrow(trimmed(run), StructType([*src.schema.fields, StructField("_score", DoubleType())]))
    return named(out, docs.columns, {"score": F.col("_score")})


def op1_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    out = score(docs, fit(docs, labels.where(~held_out())))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
