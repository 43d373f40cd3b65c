"""The cost model of point and range probing, its calibration, and the greedy partitioner of sorted probes."""

from __future__ import annotations

from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelore.operators.keys import ordinal, page_of, successor
from pagelore.schema import ITEMS_PER_PAGE


@dataclass(frozen=True)
class JoinCost:
    """Seconds per probe and page; the defaults are the published ones."""

    alpha: float = 1.637e-6
    beta: float = 1.719e-6
    eta: float = 4.421e-6
    delta: float = 0.005
    lambda_point: float = 1.195e-6
    lambda_range: float = 4.669e-7
    n_min: int = 1024
    k_max: int = 8192
    gamma: float = 0.05
    phi: float = 0.0

    def point(self, n, distinct):
        return self.delta + self.alpha * n + self.lambda_point * distinct

    def range(self, span):
        return self.beta * span + self.eta + self.lambda_range * span

    def prefers_range(self, n, span, distinct) -> bool:
        p, r = self.point(n, distinct), self.range(span)
        return n >= self.n_min and p - r > self.phi and r <= (1 - self.gamma) * p

    def env(self) -> dict[str, str]:
        return {k.upper(): repr(v) for k, v in asdict(self).items()}


def partition_cost(n: Column, span: Column, distinct: Column, c: JoinCost) -> tuple[Column, Column]:
    return c.point(n, distinct), c.range(span)


#: Probes that one task partitions from end to end.
CHUNK = 1 << 20


def partition_probes(probes: DataFrame, keys: DataFrame, eps: int, cost: JoinCost = JoinCost(), chunk: int = CHUNK, ipp: int = ITEMS_PER_PAGE) -> DataFrame:
    """probes (query_idx, key) -> (part_id, start, len, is_range, pages, span), in key order.

    A partition grows probe by probe; from n_min probes on it is cut when its pages span k_max or a range
    probe has become clearly cheaper. The scan is sequential inside chunks of so many probes, which run in
    parallel; each starts anew, so that the last partition of a chunk may be shorter than one scan would make it.
    """
    s = successor(probes, keys)
    lo, hi = page_of(F.greatest(F.col("pos") - eps, F.lit(0)), ipp), page_of(F.col("pos") + eps, ipp)
    rows = ordinal(s.select("key", "query_idx", lo.alias("lo"), hi.alias("hi")), ["key", "query_idx"], "ord")
    rows = rows.select(F.floor(F.col("ord") / chunk).cast("bigint").alias("chunk"), "ord", "lo", "hi")

    def run(batches):
        chunk_at, start, n = None, 0, 0
        first = last = union = right = 0

        def part():
            return (start, n, 1 if cost.prefers_range(n, last - first + 1, union) else 0, union, last - first + 1)

        for b in batches:
            out = []
            for c, o, a, z in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if n and c != chunk_at:
                    out.append(part())
                    n = 0
                chunk_at = c
                if not n:
                    start, first, last, union, right = o, a, z, z - a + 1, z
                else:
                    first, last = min(first, a), max(last, z)
                    union += z - a + 1 if a > right else max(0, z - right)
                    right = max(right, z)
                n += 1
                if n >= cost.n_min and (last - first + 1 >= cost.k_max or cost.prefers_range(n, last - first + 1, union)):
                    out.append(part())
                    n = 0
            if out:
                yield _parts(out)
        if n:
            yield _parts([part()])

    found = rows.repartition("chunk").sortWithinPartitions("chunk", "ord").mapInArrow(run, "start bigint, len bigint, is_range int, pages bigint, span bigint")
    return ordinal(found, ["start"], "part_id").select("part_id", "start", "len", "is_range", "pages", "span")


def _parts(rows):
    return pa.record_batch([pa.array(c, pa.int32() if i == 2 else pa.int64()) for i, c in enumerate(zip(*rows, strict=True))], names=["start", "len", "is_range", "pages", "span"])


def quartiles(df: DataFrame, col: str) -> tuple[float, float]:
    r = df.agg(F.percentile(col, F.array(F.lit(0.25), F.lit(0.75))).alias("q")).first().q
    return (r[0], r[1]) if r else (0.0, 0.0)


def iqr_filter(df: DataFrame, col: str) -> DataFrame:
    """Rows within 1.5 interquartile ranges of the quartiles (linear interpolation)."""
    a, b = quartiles(df, col)
    return df.where(F.col(col).between(a - 1.5 * (b - a), b + 1.5 * (b - a)))


def fit_point(runs: DataFrame) -> DataFrame:
    """Calibration rows -> alpha, delta (wall without I/O against probes) and lambda_point (seconds per page)."""
    per = iqr_filter(runs.where("IOs > 0").withColumn("_l", F.col("IO_time_s") / F.col("IOs")), "_l").agg(F.median("_l").alias("lambda_point"))
    line = runs.agg(F.regr_slope(F.col("total_wall_time_s") - F.col("IO_time_s"), F.col("num_queries")).alias("alpha"), F.regr_intercept(F.col("total_wall_time_s") - F.col("IO_time_s"), F.col("num_queries")).alias("delta"))
    return line.crossJoin(per)  # one row each


def fit_range(runs: DataFrame) -> DataFrame:
    """The same for ranges, against the pages spanned: beta, eta, lambda_range."""
    per = iqr_filter(runs.where("IOs > 0").withColumn("_l", F.col("IO_time_s") / F.col("IOs")), "_l").agg(F.median("_l").alias("lambda_range"))
    line = runs.agg(F.regr_slope(F.col("total_wall_time_s") - F.col("IO_time_s"), F.col("range_pages")).alias("beta"), F.regr_intercept(F.col("total_wall_time_s") - F.col("IO_time_s"), F.col("range_pages")).alias("eta"))
    return line.crossJoin(per)
