"""Six equi-join strategies of an outer probe list (row_id, key) with a unique inner key relation."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelore.operators.access import range_records
from pagelore.operators.keys import ordinal, running_total
from pagelore.runtime import stored


class JoinMode(str, Enum):
    POINT, INLJ, RANGE, HYBRID, HASH, SORTMERGE = "point", "inlj", "range", "hybrid", "hash", "sortmerge"

    @classmethod
    def parse(cls, text: str) -> JoinMode:
        name = text.strip().lower().replace("-", "").replace("_", "")
        return cls({"smj": "sortmerge", "merge": "sortmerge", "sort": "sortmerge"}.get(name, name))

    @property
    def sorts_outer(self) -> bool:
        return self not in (JoinMode.INLJ, JoinMode.HASH)


def check_partitions(parts: DataFrame, outer_rows: int) -> None:
    """Lengths are positive, flags 0 or 1, and the lengths add up to the outer relation."""
    r = parts.agg(F.coalesce(F.sum("len"), F.lit(0)).alias("n"), F.count(F.when((F.col("len") <= 0) | ~F.col("is_range").isin(0, 1), 1)).alias("bad")).first()
    if r.bad or r.n != outer_rows:
        raise ValueError(f"{r.bad} bad partitions; lengths add up to {r.n} of {outer_rows}")


def join(outer: DataFrame, inner: DataFrame, mode: JoinMode | str, parts: DataFrame | None = None) -> DataFrame:
    """(row_id, key) of each outer row with a match, once for each matching inner row.

    point, inlj: the keys are looked up one by one: an equi-join, Spark choosing how. hash: the inner
    side, whose keys are unique, is hashed, so no key makes a bucket long; sortmerge: both are sorted. range: inner is first cut to the outer's least and
    greatest key. hybrid: the outer in key order is dealt to partitions of given lengths (part_id, len,
    is_range); point partitions are looked up, range partitions fetch all inner keys between their
    first and last key and merge. inner must hold ``key`` and, for hybrid, pos and page_id.
    """
    mode = JoinMode.parse(mode) if isinstance(mode, str) else mode
    if mode in (JoinMode.POINT, JoinMode.INLJ):
        return outer.join(inner.select("key"), "key", "left_semi").select("row_id", "key")
    if mode is JoinMode.HASH:
        return outer.join(inner.select("key").hint("shuffle_hash"), "key").select("row_id", "key")
    if mode is JoinMode.SORTMERGE:
        return outer.hint("merge").join(inner.select("key").distinct(), "key").select("row_id", "key")
    if mode is JoinMode.RANGE:
        ends = outer.agg(F.min("key").alias("a"), F.max("key").alias("b")).first()
        if ends.a is None:
            return outer.select("row_id", "key")
        return outer.hint("merge").join(inner.where(F.col("key").between(ends.a, ends.b)).select("key"), "key").select("row_id", "key")
    dealt = stored(deal(outer, parts), "dealt")
    points = dealt.where("is_range = 0").join(inner.select("key"), "key", "left_semi")
    spans = dealt.where("is_range = 1").groupBy("part_id").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    fetched = range_records(spans.withColumnRenamed("part_id", "query_idx"), inner).withColumnRenamed("query_idx", "part_id")
    ranged = dealt.where("is_range = 1").join(fetched, ["part_id", "key"])
    return points.select("row_id", "key").unionByName(ranged.select("row_id", "key"))


#: Positions are matched with partitions by equality on blocks of so many.
BLOCK = 4096


def deal(outer: DataFrame, parts: DataFrame) -> DataFrame:
    """(row_id, key, part_id, is_range): the outer in key order, dealt to consecutive partitions. A partition
    names the blocks of positions that it covers, so positions find theirs by an equi-join and a bounds check."""
    rows = ordinal(outer.select("row_id", "key"), ["key", "row_id"], "ord").withColumn("_b", F.floor(F.col("ord") / BLOCK).cast("bigint"))
    ends = running_total(parts.select("part_id", F.col("len").cast("bigint").alias("len"), "is_range"), ["part_id"], "len", "end")
    spans = ends.select("part_id", "is_range", (F.col("end") - F.col("len")).alias("_from"), F.col("end").alias("_to"))
    spans = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_from") / BLOCK).cast("bigint"), F.floor((F.col("_to") - 1) / BLOCK).cast("bigint"))))
    return rows.join(spans, "_b").where("ord >= _from and ord < _to").select("row_id", "key", "part_id", "is_range")


def join_summary(joined: DataFrame, mode: JoinMode | str) -> DataFrame:
    """matched_records, checksum (sum of keys, as wide as it needs) and, for hash, the sum of row ids from 1."""
    mode = JoinMode.parse(mode) if isinstance(mode, str) else mode
    rows = F.coalesce(F.sum(F.col("row_id") + 1), F.lit(0)) if mode is JoinMode.HASH else F.lit(0).cast("bigint")
    return joined.agg(F.count("*").alias("matched_records"), F.coalesce(F.sum(F.col("key").cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").alias("checksum"), rows.alias("record_checksum"))


def hash_table_bytes(n: int) -> int:
    """Bucket heads for 1.25 n buckets, chain links, and 16-byte rows."""
    return 4 * (n + n // 4) + 4 * n + 16 * n


def sort_budget_bytes(n: int, page_bytes: int = 4096) -> int:
    return max(4 * page_bytes, hash_table_bytes(n))


def external_sort_plan(n: int, budget_bytes: int, page_bytes: int = 4096) -> dict[str, int]:
    """What an external merge sort of n keys would do: initial runs, merge passes, runs written."""
    if n == 0:
        return {"runs": 0, "passes": 0, "runs_written": 0}
    runs = -(-n // max(1, budget_bytes // 8))
    fan_in = max(2, budget_bytes // page_bytes - 1)
    left, passes, written = runs, 0, runs
    while left > 1:
        left = -(-left // fan_in)
        passes += 1
        written += left
    return {"runs": runs, "passes": passes, "runs_written": written}
