"""Workload generators: seeded mixtures of ranks, ranges, and samples of traces. Everything is a function of
(seed, row number), so a rerun of a lost task gives the same rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shares of hotspot, Zipf and uniform probes of the six named workloads.
MIXTURES = {"w1": (0.0, 0.0, 1.0), "w2": (0.0, 1.0, 0.0), "w3": (1.0, 0.0, 0.0), "w4": (0.4, 0.3, 0.3), "w5": (0.2, 0.2, 0.6), "w6": (0.1, 0.1, 0.8)}


def unit(*parts) -> Column:
    """A number in [0, 1) that is a function of its parts: 52 bits of the md5 of their texts."""
    text = F.concat_ws("|", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint") / float(1 << 52)


def zipf_rank(u: Column, n: int, a: float) -> Column:
    """0-based rank of a bounded continuous Zipf law of exponent a != 1, by inversion."""
    return F.least(F.floor(F.pow((F.pow(F.lit(float(n + 1)), F.lit(1 - a)) - 1) * u + 1, F.lit(1 / (1 - a)))) - 1, F.lit(n - 1)).cast("bigint")


def uniform_positions(u: Column, n: int) -> Column:
    return F.least(F.floor(u * n), F.lit(n - 1)).cast("bigint")


def hotspot_positions(u: Column, v: Column, n: int, spots: int, fraction: float, a: float, seed: int) -> Column:
    """One of some spots of fraction x n neighbouring ranks, a Zipf offset inside it."""
    width = max(1, int(n * fraction))
    spot = F.least(F.floor(u * spots), F.lit(spots - 1)).cast("bigint")
    start = F.floor(unit(seed, "spot", spot) * max(1, n - width + 1))
    return F.least(start + zipf_rank(v, width, a), F.lit(n - 1)).cast("bigint")


def mixture_positions(spark: SparkSession, q: int, n: int, mixture=(0.4, 0.3, 0.3), spots: int = 10, fraction: float = 0.001, a: float = 1.2, seed: int = 42) -> DataFrame:
    """(query_idx, pos): q ranks of a relation of n keys; kinds are exact shares, dealt in a shuffled order."""
    if abs(sum(mixture) - 1) > 1e-9:
        raise ValueError("shares must add up to 1")
    hot, zipf = int(round(q * mixture[0])), int(round(q * mixture[1]))
    r = spark.range(q).select(F.col("id"), unit(seed, "u", F.col("id")).alias("u"), unit(seed, "v", F.col("id")).alias("v"))
    pos = F.when(F.col("id") < hot, hotspot_positions(F.col("u"), F.col("v"), n, spots, fraction, a, seed)).when(F.col("id") < hot + zipf, zipf_rank(F.col("u"), n, a)).otherwise(uniform_positions(F.col("u"), n))
    from pagelore.operators.keys import ordinal

    mixed = r.select(pos.alias("pos"), unit(seed, "o", F.col("id")).alias("_o"), "id")
    return ordinal(mixed, ["_o", "id"], "query_idx").select("query_idx", "pos")


def allocate_windows(q: int, windows: int, mixture, jitter: float, seed: int) -> np.ndarray:
    """Counts (window, kind) with jittered shares whose columns add up to the whole mixture's counts."""
    rng = np.random.default_rng(seed)
    left = np.array([int(round(q * m)) for m in mixture])
    left[-1] = q - left[:-1].sum()
    out = np.zeros((windows, len(left)), int)
    for w in range(windows):
        size = q * (w + 1) // windows - q * w // windows
        want = np.clip(left / max(1, left.sum()) + rng.uniform(-jitter, jitter, len(left)), 0, None)
        take = np.minimum(np.floor(want / max(want.sum(), 1e-12) * size).astype(int), left)
        for k in np.argsort(-(left - take)):
            take[k] += min(size - take.sum(), left[k] - take[k])
        out[w], left = take, left - take
    return out


def windowed_positions(spark, q: int, n: int, mixture=(0.4, 0.3, 0.3), windows: int = 10, jitter: float = 0.1, seed: int = 42, **kw) -> DataFrame:
    """mixture_positions whose shares vary by window of the trace while the whole keeps them."""
    counts = allocate_windows(q, windows, mixture, jitter, seed)
    bounds = [(w, k, int(c)) for w, row in enumerate(counts) for k, c in enumerate(row) if c]
    slots = spark.createDataFrame(bounds, "w int, kind int, c int").select("w", "kind", F.explode(F.sequence(F.lit(1), F.col("c"))).alias("i"))
    u, v = unit(seed, "u", F.col("w"), F.col("kind"), F.col("i")), unit(seed, "v", F.col("w"), F.col("kind"), F.col("i"))
    a = kw.get("a", 1.2)
    pos = F.when(F.col("kind") == 0, hotspot_positions(u, v, n, kw.get("spots", 10), kw.get("fraction", 0.001), a, seed)).when(F.col("kind") == 1, zipf_rank(u, n, a)).otherwise(uniform_positions(u, n))
    from pagelore.operators.keys import ordinal

    s = slots.select("w", pos.alias("pos"), unit(seed, "o", F.col("w"), F.col("kind"), F.col("i")).alias("_o"), "kind", "i")
    return ordinal(s, ["w", "_o", "kind", "i"], "query_idx").select("query_idx", "w", "pos")


def keys_at(positions: DataFrame, ranked_keys: DataFrame) -> DataFrame:
    """Positions as keys: an equi-join on the rank."""
    return positions.join(ranked_keys.select("pos", "key"), "pos")


def range_workload(positions: DataFrame, n: int, shortest: int = 1, longest: int = 1024, seed: int = 42) -> DataFrame:
    """(query_idx, rank_lo, rank_hi): starts with uniform lengths, cut at the last key."""
    length = shortest + F.floor(unit(seed, "len", F.col("query_idx")) * (longest - shortest + 1))
    return positions.select("query_idx", F.col("pos").alias("rank_lo"), F.least(F.col("pos") + length - 1, F.lit(n - 1)).cast("bigint").alias("rank_hi"))


def key_space_ranges(spark, q: int, least: int, greatest: int, mean: float, start: str = "uniform", length: str = "uniform", seed: int = 42) -> DataFrame:
    """(query_idx, lo, hi) over the key space: starts uniform or normal, lengths uniform or exponential."""
    u, v, w = (unit(seed, k, F.col("id")) for k in ("a", "b", "c"))
    normal = F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * np.pi * v)
    at = least + (greatest - least) * (u if start == "uniform" else F.least(F.greatest(0.5 + normal / 6, F.lit(0.0)), F.lit(1.0)))
    span = 2 * mean * w if length == "uniform" else -mean * F.log(1 - w)
    lo = F.floor(at).cast("bigint")
    return spark.range(q).select(F.col("id").alias("query_idx"), lo.alias("lo"), F.least(lo + F.floor(span).cast("bigint"), F.lit(greatest)).alias("hi"))


def unique_sample(positions: DataFrame, k: int, strict: bool = False) -> DataFrame:
    """The first k distinct positions in trace order; strict: fewer is an error."""
    first = positions.groupBy("pos").agg(F.min("query_idx").alias("query_idx"))
    from pagelore.operators.keys import ordinal

    out = ordinal(first, ["query_idx"], "_r").where(F.col("_r") < k).select(F.col("_r").alias("query_idx"), "pos")
    if strict and (n := out.count()) < k:
        raise ValueError(f"{n} distinct positions of {k}")
    return out


def lookup_mix(ranked_keys: DataFrame, q: int, ratio: float, seed: int = 42) -> DataFrame:
    """(query_idx, key): a share of existing keys, the others uniform between the least and greatest."""
    spark, n = ranked_keys.sparkSession, ranked_keys.count()
    hits = int(q * ratio)
    ends = ranked_keys.agg(F.min("key").alias("a"), F.max("key").alias("b")).first()
    a = keys_at(spark.range(hits).select(F.col("id").alias("query_idx"), uniform_positions(unit(seed, "h", F.col("id")), n).alias("pos")), ranked_keys).select("query_idx", "key")
    b = spark.range(hits, q).select(F.col("id").alias("query_idx"), (F.lit(ends.a) + F.floor(unit(seed, "m", F.col("id")) * (ends.b - ends.a))).cast("bigint").alias("key"))
    return a.unionByName(b)


def prefixes(trace: DataFrame, rates: list[float]) -> DataFrame:
    """trace + rate: for each rate the first share of the trace, one row at least. Not a random sample."""
    q = trace.count()
    r = F.explode(F.array(*[F.struct(F.lit(float(x)).alias("rate"), F.lit(max(1, int(q * x))).alias("_upto")) for x in rates])).alias("_x")
    return trace.select("*", r).where(F.col("query_idx") < F.col("_x._upto")).select(*trace.columns, F.col("_x.rate").alias("rate"))


def learning_prefix(trace: DataFrame, share: float) -> DataFrame:
    return trace.where(F.col("query_idx") < max(1, int(trace.count() * share)))
