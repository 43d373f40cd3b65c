"""Predictors: where a key lies, within an error bound. windows(probes) adds pred, page_lo, page_hi."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelore.operators.keys import page_of, predecessor
from pagelore.schema import ITEMS_PER_PAGE


class Predictor(Protocol):
    def windows(self, probes: DataFrame) -> DataFrame: ...


def lower_bound(pos: Column, eps) -> Column:
    return F.greatest(pos - eps, F.lit(0))


def upper_bound(pos: Column, eps, n) -> Column:
    """One past the last position."""
    return F.least(pos + eps + 2, F.lit(n) if isinstance(n, int) else n)


def page_window(df: DataFrame, pos: Column, eps, n, ipp: int = ITEMS_PER_PAGE) -> DataFrame:
    """df + page_lo, page_hi of the positions [pos - eps, pos + eps + 2), cut to [0, n)."""
    lo, hi = lower_bound(pos, eps), upper_bound(pos, eps, n)
    df = df.withColumn("page_lo", page_of(lo, ipp))
    return df.withColumn("page_hi", F.greatest("page_lo", F.when(hi > lo, page_of(hi - 1, ipp)).otherwise(F.col("page_lo"))))


class Exact:
    """The true predecessor rank as the model."""

    def __init__(self, ranked_keys: DataFrame, eps: int, ipp: int = ITEMS_PER_PAGE):
        self.keys, self.eps, self.ipp = ranked_keys, eps, ipp

    def windows(self, probes: DataFrame) -> DataFrame:
        n = self.keys.count()
        return page_window(predecessor(probes, self.keys).withColumnRenamed("pos", "pred"), F.col("pred"), self.eps, n, self.ipp)


class Pgm:
    """Piecewise-linear segments: the rightmost one that starts at or before the key predicts it."""

    def __init__(self, ranked_keys: DataFrame, segments: DataFrame, eps: int, ipp: int = ITEMS_PER_PAGE):
        self.keys, self.segments, self.eps, self.ipp = ranked_keys, segments.where("level = 0"), eps, ipp

    def windows(self, probes: DataFrame) -> DataFrame:
        n = self.keys.count()
        first = self.keys.agg(F.min("key")).first()[0]
        p = predecessor(probes.withColumn("_own", F.col("key")).withColumn("key", F.greatest("key", F.lit(first))), self.segments.select("key")).withColumnRenamed("pos", "seg_id")
        p = p.join(self.segments.select("seg_id", F.col("key").alias("_at"), "slope", "intercept", "next_intercept"), "seg_id")
        pred = F.greatest(F.lit(0), F.least(F.floor(F.col("slope") * (F.col("key") - F.col("_at")).cast("double")).cast("bigint") + F.col("intercept"), F.col("next_intercept")))
        p = p.withColumn("pred", pred).drop("_at", "slope", "intercept", "next_intercept", "key").withColumnRenamed("_own", "key")
        return page_window(p, F.col("pred"), self.eps, n, self.ipp)


class Leaves:
    """A two-layer model: probes are routed to a leaf, whose line and error predict; the window has no +2."""

    def __init__(self, model, n: int, ipp: int = ITEMS_PER_PAGE):
        self.model, self.n, self.ipp = model, n, ipp

    def windows(self, probes: DataFrame) -> DataFrame:
        p = self.model.predict(probes)
        last = F.lit((self.n - 1) // self.ipp).cast("bigint")
        lo = F.greatest(F.col("pred") - F.col("err"), F.lit(0))
        hi = F.least(F.col("pred") + F.col("err"), F.lit(self.n - 1))
        p = p.withColumn("page_lo", F.least(page_of(lo, self.ipp), last))
        return p.withColumn("page_hi", F.greatest("page_lo", F.least(page_of(hi, self.ipp), last)))
