"""Ranks, pages and fences of sorted key relations, distributed.

The one primitive is a running total over a global order: rows are range-partitioned and sorted, the sorted
rows are checkpointed with their partition's number (range bounds are sampled, so a recomputation could deal rows
differently, and in a union a task has another number than its partition), each partition's total is summed up,
and a kernel adds the totals of the partitions before it. One shuffle, no
single-partition window; the driver sees one number per partition. Ties in the order are broken by further
columns, which also lets a key with very many rows spread over several partitions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from pagelore.runtime import cut
from pagelore.schema import ITEMS_PER_PAGE, SENTINEL


def running(df: DataFrame, order: list[str], cols: dict[str, str | None], how: str = "sum") -> DataFrame:
    """df + for each name of cols the running sum (or min) of its column, or of 1, over the rows up to this one.
    All columns share one sort. Sums of integers are exact; those of doubles are added in extended precision."""
    rows = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_run", F.spark_partition_id()))
    kinds = {n: LongType() if c is None or dict(df.dtypes)[c] in ("int", "bigint") else DoubleType() for n, c in cols.items()}
    of = F.sum if how == "sum" else F.min
    aggs = [(F.count("*") if c is None else of(c)).alias(n) for n, c in cols.items()]
    ends = {r["_run"]: r for r in rows.groupBy("_run").agg(*aggs).collect()}  # a row for each partition
    before, at = {}, {n: 0 if how == "sum" else None for n in cols}
    for part in sorted(ends):
        before[part] = dict(at)
        for n in cols:
            x = ends[part][n]
            at[n] = at[n] if x is None else at[n] + x if how == "sum" else x if at[n] is None else min(at[n], x)
    index = {n: df.columns.index(c) for n, c in cols.items() if c}
    fields = [(n, pa.int64() if isinstance(t, LongType) else pa.float64()) for n, t in kinds.items()]

    def run(batches):
        part, at = None, {}
        for b in batches:
            if not b.num_rows:
                continue
            if (own := b.column(b.num_columns - 1)[0].as_py()) != part:
                part, at = own, dict(before[own])
            out = []
            for n, t in fields:
                kind = np.int64 if t == pa.int64() else np.longdouble
                if how == "sum":
                    x = np.ones(b.num_rows, kind) if n not in index else b.column(index[n]).fill_null(0).to_numpy(zero_copy_only=False).astype(kind)
                    x = kind(at[n]) + np.cumsum(x)
                else:
                    x = np.minimum.accumulate(b.column(index[n]).to_numpy(zero_copy_only=False).astype(kind))
                    x = x if at[n] is None else np.minimum(x, kind(at[n]))
                at[n] = x[-1]
                out.append(pa.array(x.astype(np.int64 if t == pa.int64() else np.float64), t))
            yield pa.record_batch([*b.columns[:-1], *out], schema=pa.schema([*list(b.schema)[:-1], *fields]))

    return rows.mapInArrow(run, StructType([*df.schema.fields, *[StructField(n, t) for n, t in kinds.items()]]))


def running_total(df: DataFrame, order: list[str], weight: str | None = None, name: str = "total") -> DataFrame:
    """df + name: the sum of the integer column weight (or 1) over the rows up to this one in the order."""
    return running(df, order, {name: weight})


def ordinal(df: DataFrame, order: list[str], name: str = "pos") -> DataFrame:
    """df + name: 0-based position in the order."""
    return running_total(df, order, name=name).withColumn(name, F.col(name) - 1)


def page_of(pos: Column, ipp: int = ITEMS_PER_PAGE) -> Column:
    return F.floor(pos / ipp).cast("bigint")


def fix_sentinel(keys: DataFrame, col: str = "key") -> DataFrame:
    """The reserved key becomes the one below it."""
    return keys.withColumn(col, F.when(F.col(col) == SENTINEL, SENTINEL - 1).otherwise(F.col(col)))


def count_sentinels(keys: DataFrame, col: str = "key") -> DataFrame:
    return keys.agg(F.coalesce(F.sum((F.col(col) == SENTINEL).cast("bigint")), F.lit(0)).alias("fixed"))


def safe_ranges(ranges: DataFrame) -> DataFrame:
    """Ranges that touch the reserved key go, lo > hi is swapped."""
    r = ranges.where((F.col("lo") != SENTINEL) & (F.col("hi") != SENTINEL))
    return r.withColumns({"lo": F.least("lo", "hi"), "hi": F.greatest("lo", "hi")})


def ranked(keys: DataFrame, ipp: int = ITEMS_PER_PAGE) -> DataFrame:
    """(key, pos, page_id) of the distinct keys."""
    return ordinal(keys.select("key").where("key is not null").distinct(), ["key"]).withColumn("page_id", page_of(F.col("pos"), ipp))


def fences(ranked_keys: DataFrame) -> DataFrame:
    """(page_id, first_key, last_key, n)."""
    return ranked_keys.groupBy("page_id").agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.count("*").alias("n"))


def layout(ranked_keys: DataFrame, ipp: int = ITEMS_PER_PAGE) -> DataFrame:
    return ranked_keys.agg(F.count("*").alias("total_keys"), F.ceil(F.count("*") / ipp).cast("bigint").alias("pages"))


def rank_of(probes: DataFrame, keys: DataFrame, inclusive: bool, id_col: str = "query_idx", name: str = "rank") -> DataFrame:
    """probes + the number of keys <= (or <) the probe's key: an as-of join by one sort of the union."""
    tag = 1 if inclusive else -1
    u = keys.select(F.col("key").alias("_k"), F.lit(0).alias("_tag"), F.lit(None).cast("bigint").alias("_id"), F.lit(1).cast("bigint").alias("_w"))
    p = probes.select(F.col("key").alias("_k"), F.lit(tag).alias("_tag"), F.col(id_col).cast("bigint").alias("_id"), F.lit(0).cast("bigint").alias("_w"), F.struct(*probes.columns).alias("_row"))
    both = u.withColumn("_row", F.lit(None).cast(p.schema["_row"].dataType)).unionByName(p)
    return running_total(both, ["_k", "_tag", "_id"], "_w", name).where(f"_tag = {tag}").select("_row.*", name)


def predecessor(probes: DataFrame, keys: DataFrame, **kw) -> DataFrame:
    """probes + pos: the rank of the greatest key <= the probe, 0 below the least."""
    return rank_of(probes, keys, True, name="_r", **kw).withColumn("pos", F.greatest(F.col("_r") - 1, F.lit(0))).drop("_r")


def successor(probes: DataFrame, keys: DataFrame, **kw) -> DataFrame:
    """probes + pos: the rank of the least key >= the probe, the number of keys above the greatest."""
    return rank_of(probes, keys, False, name="pos", **kw)


def ranks_of_ends(ranges: DataFrame, keys: DataFrame) -> DataFrame:
    """ranges (query_idx, lo, hi) + _below, _upto: the number of keys < lo and <= hi. Both ends go through one sort
    of the keys; ranges that repeat a query are told apart by their bounds, repeated ones stay repeated."""
    ends = ranges.select("query_idx", "lo", "hi", F.explode(F.array(F.lit(-1), F.lit(1))).alias("_tag"))
    row = F.struct("query_idx", "lo", "hi").alias("_row")
    p = ends.select(F.when(F.col("_tag") < 0, F.col("lo")).otherwise(F.col("hi")).alias("_k"), "_tag", F.lit(0).cast("bigint").alias("_w"), row)
    k = keys.select(F.col("key").alias("_k"), F.lit(0).alias("_tag"), F.lit(1).cast("bigint").alias("_w"), F.lit(None).cast(p.schema["_row"].dataType).alias("_row"))
    r = running_total(k.unionByName(p), ["_k", "_tag", "_row"], "_w", "_n").where("_tag <> 0")
    side = lambda t: F.max(F.when(F.col("_tag") == t, F.col("_n")))
    r = r.groupBy("_row").agg(side(-1).alias("_below"), side(1).alias("_upto"), F.count(F.when(F.col("_tag") == 1, 1)).alias("_times"))
    r = r.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_times"))))
    return r.select("_row.*", "_below", "_upto")


def gap_stats(ranked_keys: DataFrame) -> DataFrame:
    """Mean and population deviation of the gaps between neighbours, and kappa = mean^2 / variance.
    Neighbours meet by an equi-join on the rank, not in a single-partition window."""
    nxt = ranked_keys.select((F.col("pos") - 1).alias("pos"), F.col("key").alias("next"))
    gap = (F.col("next") - F.col("key")).cast("double")
    g = ranked_keys.join(nxt, "pos").agg(F.count("*").alias("gaps"), F.avg(gap).alias("mean_gap"), F.stddev_pop(gap).alias("std_gap"))
    return g.withColumn("kappa", F.when(F.col("std_gap") > 0, F.pow(F.col("mean_gap") / F.col("std_gap"), 2)))


def prefix(ranked_keys: DataFrame, n: int) -> DataFrame:
    """The first n keys."""
    return ranked_keys.where(F.col("pos") < n)


def every_kth(ranked_keys: DataFrame, step: int) -> DataFrame:
    return ranked_keys.where(F.col("pos") % step == 0)


def unsorted_pairs(keys: DataFrame, idx: str = "query_idx") -> DataFrame:
    """How many neighbours in file order are out of order or equal: 0 for a sorted, unique relation."""
    nxt = keys.select((F.col(idx) - 1).alias(idx), F.col("key").alias("next"))
    return keys.join(nxt, idx).agg(F.coalesce(F.sum((F.col("next") < F.col("key")).cast("bigint")), F.lit(0)).alias("descents"), F.coalesce(F.sum((F.col("next") == F.col("key")).cast("bigint")), F.lit(0)).alias("repeats"))
