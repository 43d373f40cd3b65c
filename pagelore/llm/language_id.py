"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed character n-grams of words (with word-end markers). IDF counts documents over all rows
that may be learned from, one pass with a partial count per task. TF is the share of the text's n-grams,
so a text's logits are the mean over its n-grams of idf x weight: a word's contribution is computed once
and looked up for each further occurrence. Weights are trained with follow-the-regularised-leader and an
elastic net (L1 for sparsity, L2) on a bounded sample of labelled rows, the sample's rest calibrates a
temperature. The model, a matrix of 2^BITS by languages, goes to the executors once.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelore.llm.common import give_back, held_out, trimmed
from pagelore.llm.ngrams import WordRows, in_groups, ngram_buckets, per_word_sums, words_of
from pagelore.runtime import stored, table

BITS, SIZES = 15, range(1, 5)
#: The classifier is fitted on at most this many labelled rows of each language, in hash order.
SAMPLE_ROWS = 600
TRAIN = {"alpha": 4.0, "beta": 1.0, "l1": 0.02, "l2": 0.001, "epochs": 6, "scale": 30.0}
UNDETERMINED = "und"


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Documents in which each bucket occurs, over all rows of (text), and the number of rows."""

    def run(batches):
        df, n = np.zeros(1 << BITS, np.int64), 0
        sets = BucketSets()
        for b in batches:
            for sizes, flat in in_groups(b.column(0).to_pylist()):
                sets.learn(flat)
                n, at = n + len(sizes), 0
                for k in sizes:
                    if k:
                        df[sets.of(set(flat[at : at + k]))] += 1
                    at += k
        at = np.flatnonzero(df)
        yield pa.record_batch([pa.array(np.r_[-1, at]), pa.array(np.r_[n, df[at]])], names=["bucket", "n"])

    counts = texts.mapInArrow(trimmed(run), "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # 2^BITS + 1 rows at most
    df = np.zeros(1 << BITS, np.int64)
    total = 0
    for r in counts:
        if r.bucket < 0:
            total = r.n
        else:
            df[r.bucket] = r.n
    return df, total


class BucketSets:
    """The buckets of a set of words. Buckets of words are computed for many texts at once and kept, up to a bound."""

    def __init__(self, cap: int = 100_000):
        self.cap, self.seen = cap, np.zeros(1 << BITS, bool)
        self._forget()

    def _forget(self) -> None:
        """number: word -> row of start and size, which say where its buckets are."""
        self.number, self.buckets, self.start, self.size = {}, np.zeros(0, np.uint16), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, words: list[str]) -> None:
        words = list(dict.fromkeys(words))
        new = [w for w in words if w not in self.number]
        if len(self.number) + len(new) > self.cap and self.number:
            self._forget()
            new = words
        if new:
            at, bucket = ngram_buckets(new, SIZES, BITS)
            size = np.bincount(at, minlength=len(new))
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
            self.start = np.concatenate([self.start, len(self.buckets) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.buckets = np.concatenate([self.buckets, bucket.astype(np.uint16)])

    def of(self, words: set[str]) -> np.ndarray:
        """The buckets of words that have been learned, as indexes."""
        at = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        n = self.size[at]
        ends = np.cumsum(n)
        self.seen[self.buckets[np.arange(ends[-1]) + np.repeat(self.start[at] - ends + n, n)]] = True
        out = np.flatnonzero(self.seen)
        self.seen[out] = False
        return out


def _tfidf(texts: list[str], idf: np.ndarray, scale: float):
    """Per text the (buckets, values) of its sparse vector: scale x share of n-grams x idf."""
    out = []
    for t in texts:
        w = words_of(t)
        _, b = ngram_buckets(w, SIZES, BITS)
        n = np.bincount(b, minlength=1)
        at = np.flatnonzero(n)
        out.append((at, scale * n[at] / max(1, len(b)) * idf[at]))
    return out


def train_ftrl(rows, labels: np.ndarray, k: int, alpha: float, beta: float, l1: float, l2: float, epochs: int, seed: int = 7, **_):
    """FTRL-proximal over sparse rows: z, n per coordinate; a weight is zero until |z| passes l1. The bias is
    the last coordinate, of value 1 in each row and without l1."""
    z, n = np.zeros(((1 << BITS) + 1, k)), np.zeros(((1 << BITS) + 1, k))
    rng, last = np.random.default_rng(seed), 1 << BITS
    rows = [(np.r_[at, last], np.r_[x, 1.0]) for at, x in rows]

    def weights(z, n):
        """Of rows of coordinates of which the last is the bias."""
        lasso = np.full((len(z), 1), l1)
        lasso[-1] = 0
        return np.where(np.abs(z) <= lasso, 0.0, -(z - np.sign(z) * lasso) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            w = weights(z[at], n[at])
            p = _softmax((x @ w)[None, :])[0]
            p[labels[i]] -= 1
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(z, n)
    return w[:-1], w[-1]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least negative log likelihood, by golden-section search on its logarithm."""
    if not len(labels):
        return 1.0
    loss = lambda t: -np.log(np.maximum(_softmax(logits / np.exp(t))[np.arange(len(labels)), labels], 1e-12)).mean()
    a, b, g = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


class Model:
    def __init__(self, langs, table_, bias, temperature):
        self.uid, self.langs, self.table, self.bias, self.temperature = uuid.uuid4().hex, langs, table_, bias, temperature

    def _make(self, words):
        at, bucket = ngram_buckets(words, SIZES, BITS)
        return np.c_[per_word_sums(at, self.table[bucket], len(words)), np.bincount(at, minlength=len(words))]

    def predict(self, texts) -> list[tuple[str, float]]:
        if not self.langs:
            return [(UNDETERMINED, 0.0) for _ in texts]
        words = WordRows.of_model(self.uid, self._make, len(self.langs) + 1)
        out = []
        for sizes, flat in in_groups(texts):
            rows, at = words.of(flat), 0
            for n in sizes:
                if n and any(c.isalpha() for w in flat[at : at + n] for c in w):  # numerals such as Roman ones are no letters
                    total = rows[at : at + n].sum(axis=0)
                    p = _softmax(((total[:-1] / total[-1] + self.bias) / self.temperature)[None, :])[0]
                    best = int(p.argmax())
                    out.append((self.langs[best], float(p[best])))
                else:
                    out.append((UNDETERMINED, 0.0))
                at += n
        return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS, **train) -> Model:
    """A model of rows of docs with a language: all give document frequencies, at most sample_rows of
    each language the weights, every language there is being learned. One in six sample rows calibrates."""
    setup = TRAIN | train
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = stored(rows.groupBy("lang").agg(F.count("*").alias("n")), "langs").orderBy("lang").collect()  # a row per language
    if not counts:
        return Model([], np.zeros((1 << BITS, 0)), np.zeros(0), 1.0)
    langs = sorted(r.lang for r in counts)
    # A hash threshold by language keeps about four times the sample in one scan; the exact cut sorts only that.
    h = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 40)).cast("double") / float(1 << 40)
    share = F.create_map(*[F.lit(v) for r in counts for v in (r.lang, min(1.0, 4.0 * sample_rows / r.n))])
    some = rows.where(h <= share[F.col("lang")]).withColumn("h", h)
    first = Window.partitionBy("lang").orderBy("h", "id", "text")
    sample = some.withColumn("r", F.row_number().over(first)).where(F.col("r") <= sample_rows).orderBy("lang", "r")
    got = sample.select("text", "lang").collect()
    df, total = document_frequencies(rows.select("text"))
    idf = np.log((1 + total) / (1 + df)) + 1
    texts, y = [r.text for r in got], np.array([langs.index(r.lang) for r in got])
    x = _tfidf(texts, idf, setup["scale"])
    cal = np.arange(len(y)) % 6 == 5
    w, bias = train_ftrl([v for v, c in zip(x, cal, strict=True) if not c], y[~cal], len(langs), **{k: v for k, v in setup.items() if k != "scale"})
    logits = np.array([v @ w[at] + bias for at, v in x]).reshape(len(x), len(langs))
    model = Model(langs, w * idf[:, None] * setup["scale"], bias, fit_temperature(logits[cal], y[cal]))
    del got, texts, x
    give_back()
    return model


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row: a learned language and its calibrated probability, or
    ``und`` and 0 for a null text, one without a letter, or a model that learned no language. Only the two
    columns are read, whatever the names of the others; ids are whole numbers, others fail. Repeated rows give
    repeated rows, of two equally likely languages the first by name is given, an empty table gives none."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS x languages doubles

    def run(batches):
        m = shared.value
        for b in batches:
            got = m.predict(b.column(1).to_pylist())
            yield pa.record_batch([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(trimmed(run), "id bigint, lang_pred string, score double")


def op10_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identify(docs, fit(docs.where(~held_out())))
    return out.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "lang_pred", "score")
