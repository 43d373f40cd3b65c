"""Point and range access: which pages a probe asks for, and what it finds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelore.operators.keys import page_of, ranks_of_ends, running, successor
from pagelore.schema import ITEMS_PER_PAGE


def found(probes: DataFrame, keys: DataFrame) -> DataFrame:
    """probes + found: an equi-join on the key; keys are unique, so rows stay as they are."""
    return probes.join(keys.select("key", F.lit(True).alias("found")), "key", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def point_lookup(probes: DataFrame, keys: DataFrame, predictor, strategy: str = "all_in_once", ipp: int = ITEMS_PER_PAGE) -> DataFrame:
    """probes + pred, page_lo, page_hi, dac, found. dac, the pages requested: the whole window at once; or
    one by one up to the first page whose last key reaches the probe, which is the successor's page."""
    w = predictor.windows(probes)
    if strategy == "all_in_once":
        w = w.withColumn("dac", F.col("page_hi") - F.col("page_lo") + 1)
    elif strategy == "one_by_one":
        w = successor(w, keys)
        stop = F.greatest("page_lo", F.least(page_of(F.col("pos"), ipp), F.col("page_hi")))
        w = w.withColumn("dac", stop - F.col("page_lo") + 1).drop("pos")
    else:
        raise ValueError(f"unknown strategy {strategy}")
    return found(w, keys)


def page_trace(looked_up: DataFrame) -> DataFrame:
    """(query_idx, seq, page_id): every page requested, in the order of (query_idx, seq)."""
    return looked_up.select("query_idx", F.posexplode(F.sequence("page_lo", F.col("page_lo") + F.col("dac") - 1)).alias("seq", "page_id"))


def range_windows(ranges: DataFrame, predictor) -> DataFrame:
    """(query_idx, lo, hi, page_lo, page_hi): from the least to the greatest page of both ends' windows."""
    r = ranges.select("query_idx", F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi"))
    ends = r.select("query_idx", F.explode(F.array("lo", "hi")).alias("key"))
    w = predictor.windows(ends).groupBy("query_idx").agg(F.min("page_lo").alias("page_lo"), F.max("page_hi").alias("page_hi"))
    return r.join(w, "query_idx")


def range_counts(ranges: DataFrame, keys: DataFrame) -> DataFrame:
    """(query_idx, lo, hi, matched): the keys inside each range, as a difference of two ranks: no join."""
    r = ranges.select("query_idx", F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi"))
    return ranks_of_ends(r, keys).select("query_idx", "lo", "hi", (F.col("_upto") - F.col("_below")).alias("matched"))


def range_records(ranges: DataFrame, ranked_keys: DataFrame, ipp: int = ITEMS_PER_PAGE) -> DataFrame:
    """(query_idx, key, pos, page_id): every key inside each range. The pages a range covers come from the ranks
    of its ends; ranges and keys meet by equality on the page, then the ranks are checked."""
    r = ranges.select("query_idx", F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi"))
    r = ranks_of_ends(r, ranked_keys).where("_upto > _below")
    pages = r.select("query_idx", "_below", "_upto", F.explode(F.sequence(page_of(F.col("_below"), ipp), page_of(F.col("_upto") - 1, ipp))).alias("page_id"))
    return pages.join(ranked_keys.select("key", "pos", "page_id"), "page_id").where("pos >= _below and pos < _upto").select("query_idx", "key", "pos", "page_id")


def range_sums(ranges: DataFrame, keys: DataFrame, sums: dict[str, str | None]) -> DataFrame:
    """(query_idx, *sums): for each query with records in its ranges their number (None) or the sum of an integer
    column of keys, as differences of running totals at the ends: one sort, and no record is made."""
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    sums = {"_records": None, **sums}
    end = lambda k, tag: F.struct(k.alias("_k"), F.lit(tag).alias("_tag"))
    p = ranges.select("query_idx", F.explode(F.array(end(F.least("lo", "hi"), -1), end(F.greatest("lo", "hi"), 1))).alias("_e")).select("_e.*", "query_idx", *[zero.alias(n) for n in sums])
    k = keys.select(F.col("key").alias("_k"), F.lit(0).alias("_tag"), F.lit(None).cast(p.schema["query_idx"].dataType).alias("query_idx"), *[(one if c is None else F.col(c).cast("bigint")).alias(n) for n, c in sums.items()])
    t = running(k.unionByName(p), ["_k", "_tag", "query_idx"], {f"_to_{n}": n for n in sums}).where("_tag <> 0")
    return t.groupBy("query_idx").agg(*[F.sum(F.col("_tag") * F.col(f"_to_{n}")).alias(n) for n in sums]).where("_records > 0").drop("_records")


def range_matching(ranges: DataFrame, ranked_keys: DataFrame, probes: DataFrame) -> DataFrame:
    """range_records that are also among the probes; each record once, however often it is probed."""
    return range_records(ranges, ranked_keys).join(probes.select("key"), "key", "left_semi")


def range_match_counts(ranges: DataFrame, keys: DataFrame, probes: DataFrame, name: str = "records") -> DataFrame:
    """(query_idx, records): how many range_matching rows each query has, if any, by running totals."""
    hit = probes.select("key").distinct().withColumn("_hit", F.lit(1).cast("bigint"))
    k = keys.select("key").join(hit, "key", "left").select("key", F.coalesce("_hit", F.lit(0).cast("bigint")).alias("_hit"))
    return range_sums(ranges, k, {name: "_hit"}).where(F.col(name) > 0)


def query_metrics(flagged: DataFrame) -> DataFrame:
    """Page requests with a hit flag (query_idx, seq, page_id, hit) -> per query dac, hits, misses and
    device_ios: contiguous misses are one physical read."""
    from pyspark.sql import Window

    w = Window.partitionBy("query_idx").orderBy("seq")
    new = (~F.col("hit")) & (F.coalesce(F.lag("hit").over(w), F.lit(True)) | (F.col("page_id") != F.lag("page_id").over(w) + 1))
    f = flagged.withColumn("_new", new.cast("bigint"))
    return f.groupBy("query_idx").agg(F.count("*").alias("dac"), F.sum(F.col("hit").cast("bigint")).alias("hits"), F.sum((~F.col("hit")).cast("bigint")).alias("misses"), F.sum("_new").alias("device_ios"))
