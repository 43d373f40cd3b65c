"""Closed-form hit ratios from page popularity.

A page's request share q depends on its count alone, so a popularity table is summed up as a histogram (refs,
pages). With whole counts the histogram has at most sqrt(2 x requests) rows, however many pages there are; the
characteristic-time equations are then solved on it. A histogram above LOCAL_ROWS rows, which fractional counts
can give, is not collected: each round evaluates many candidate times in one aggregation.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelore.runtime import stored

LOCAL_ROWS, POINTS = 200_000, 48


class Popularity:
    """pages: (refs) or (page_id, refs), one row per page. Counts of zero or less play no part."""

    def __init__(self, pages: DataFrame):
        h = stored(pages.where("refs > 0").groupBy(F.col("refs").cast("double").alias("refs")).agg(F.count("*").alias("pages")), "histogram")
        t = h.agg(F.sum(F.col("refs") * F.col("pages")).alias("total"), F.sum("pages").alias("pages"), F.count("*").alias("rows")).first()
        self.total, self.pages, self.hist = t.total or 0.0, t.pages or 0, h
        self.local = None
        if t.rows <= LOCAL_ROWS:
            rows = h.orderBy(F.desc("refs")).collect()
            self.local = np.array([r.refs for r in rows]) / (self.total or 1), np.array([r.pages for r in rows], dtype=float)

    def sums(self, term_np, term_col, xs) -> np.ndarray:
        """For each x the sum over all pages of term(q, x)."""
        if self.local is not None:
            q, n = self.local
            return np.array([float((term_np(q, x) * n).sum()) for x in xs])
        q = F.col("refs") / F.lit(self.total)
        row = self.hist.agg(*[F.sum(term_col(q, F.lit(float(x))) * F.col("pages")).alias(f"x{i}") for i, x in enumerate(xs)]).first()
        return np.array([float(v) for v in row])

    def solve(self, term_np, term_col, target: float) -> float:
        """The x at which the increasing sum reaches the target."""
        lo, hi = 0.0, 1.0
        while self.sums(term_np, term_col, [hi])[0] < target:
            lo, hi = hi, hi * 10
            if hi > 1e30:
                return math.inf
        while hi - lo > 1e-12 * max(1.0, hi):
            xs = np.linspace(lo, hi, POINTS + 2)[1:-1]
            k = int(np.searchsorted(self.sums(term_np, term_col, xs), target))
            new = (xs[k - 1] if k else lo, xs[k] if k < POINTS else hi)
            if new == (lo, hi):
                break
            lo, hi = new
        return float((lo + hi) / 2)


def _lru_np(q, t):
    return -np.expm1(-q * t)


def _lru_col(q, t):
    return -F.expm1(-q * t)


def _fifo_np(q, t):
    return q * t / (1 - q + q * t)


def _fifo_col(q, t):
    return q * t / (1 - q + q * t)


def che_time(p: Popularity, capacity: float) -> float:
    """LRU characteristic time: 0 without room, infinite if everything fits."""
    return 0.0 if capacity <= 0 else math.inf if capacity >= p.pages else p.solve(_lru_np, _lru_col, capacity)


def fifo_time(p: Popularity, capacity: float) -> float:
    return 0.0 if capacity <= 0 else math.inf if capacity >= p.pages else p.solve(_fifo_np, _fifo_col, capacity)


def clamp(x: float) -> float:
    return float(min(1.0, max(0.0, x)))


def lru_hit_ratio(p: Popularity, capacity: float) -> float:
    t = che_time(p, capacity)
    return 1.0 if t == math.inf else clamp(p.sums(lambda q, x: q * _lru_np(q, x), lambda q, x: q * _lru_col(q, x), [t])[0])


def fifo_hit_ratio(p: Popularity, capacity: float) -> float:
    t = fifo_time(p, capacity)
    return 1.0 if t == math.inf else clamp(p.sums(lambda q, x: q * _fifo_np(q, x), lambda q, x: q * _fifo_col(q, x), [t])[0])


def lfu_hit_ratio(p: Popularity, capacity: float) -> float:
    """The share of requests that go to the most popular pages that fit."""
    room = int(max(0, capacity))
    if p.local is not None:
        q, n = p.local
        take = np.clip(room - (np.cumsum(n) - n), 0, n)
        return clamp(float((q * take).sum()))
    from pagelore.operators.keys import running_total

    h = running_total(p.hist.withColumn("_d", -F.col("refs")), ["_d"], "pages", "_upto")
    take = F.greatest(F.lit(0), F.least(F.col("pages"), F.lit(room) - F.col("_upto") + F.col("pages")))
    return clamp(h.select((take * F.col("refs")).alias("x")).agg(F.sum("x")).first()[0] / p.total)


def hit_ratio(policy: str, capacity: float, p: Popularity) -> float:
    """RANDOM is as FIFO; NONE never hits; an empty popularity never hits."""
    if not p.pages or policy.upper() == "NONE":
        return 0.0
    return {"LRU": lru_hit_ratio, "FIFO": fifo_hit_ratio, "RANDOM": fifo_hit_ratio, "LFU": lfu_hit_ratio}[policy.upper()](p, capacity)


def hit_ratios(p: Popularity, capacity: float, policies=("FIFO", "LRU", "LFU")) -> dict[str, float]:
    return {x: hit_ratio(x, capacity, p) for x in policies}


def page_hit_probs(pages: DataFrame, policy: str, capacity: float) -> DataFrame:
    """pages (page_id, refs) + q, hit_prob. Of equally popular pages LFU holds those of smaller id."""
    p = Popularity(pages)
    q = F.col("refs") / F.lit(p.total or 1.0)
    out = pages.withColumn("q", q)
    policy = policy.upper()
    if policy == "LFU":
        from pagelore.operators.keys import ordinal

        top = ordinal(out.withColumn("_d", -F.col("refs")), ["_d", "page_id"], "_r")
        return top.withColumn("hit_prob", (F.col("_r") < int(max(0, capacity))).cast("double")).drop("_d", "_r")
    t = (che_time if policy == "LRU" else fifo_time)(p, capacity)
    prob = F.lit(1.0) if t == math.inf else (_lru_col if policy == "LRU" else _fifo_col)(F.col("q"), F.lit(t))
    return out.withColumn("hit_prob", F.when(F.col("refs") > 0, prob).otherwise(F.lit(0.0)))


def lfu_cold_hit_ratio(p: Popularity, capacity: float, requests: float, rho: str = "none") -> float:
    """LFU on a finite trace: the first request of each held page misses; rho none, linear or exp
    weighs how far the trace fills the cache."""
    base = lfu_hit_ratio(p, capacity)
    fill = requests / capacity if capacity > 0 else 0.0
    factor = {"none": 1.0, "linear": min(1.0, fill), "exp": -math.expm1(-fill)}[rho]
    return clamp(factor * base - min(capacity, p.pages) / requests if requests > 0 else 0.0)


def zipf(spark, n: int, alpha: float) -> DataFrame:
    """(page_id, q) with q proportional to 1 / rank^alpha."""
    z = spark.range(n).select(F.col("id").alias("page_id"), F.pow(F.col("id") + 1, F.lit(-alpha)).alias("w"))
    total = z.agg(F.sum("w")).first()[0]
    return z.select("page_id", (F.col("w") / F.lit(total)).alias("q"))
