"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

Each step groups only what survived the one before: rows alone in their length class never have
their prefix hashed, rows alone in their (length, prefix) class never have their full text hashed.
Groups are counted with map-side partial aggregation, so a group of copies that holds a third of all
rows costs one partial row per task. What is open after a step goes to the rows as a membership filter of
bounded size, so there is one plan at every size and texts are never shuffled: a filter that is full lets
unique rows through, which the next step finds alone. Only ids and full hashes of survivors are shuffled,
those of large groups not even then. Native only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelore.llm.common import FILTER_WORDS, ascii_lower, may_hold, membership, split_join
from pagelore.runtime import stored, table

PREFIX_CHARS = 128


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), prefix_chars: int = PREFIX_CHARS, filter_words: int = FILTER_WORDS) -> DataFrame:
    """One row per input row: ``id_col``, the ``carry`` columns, keep_id, group_size, kept, full_hash.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the
    row with the largest id stays (a null id is smaller than any other); rows that repeat the kept
    id are one document and stay with it. full_hash (SHA-256 of the normalised text) is null for
    rows that an earlier step proved unique. An empty table gives an empty result. Other columns of
    ``docs``, whatever their names, are not read unless carried. Ids may be of any type that has an order.
    filter_words bounds each of the two broadcast filters, in words of 64 bits.
    """
    at = docs.columns.index
    rows = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    carried = [f"_carry{i}" for i in range(len(carry))]
    text = F.coalesce(F.col(f"_c{at(text_col)}"), F.lit(""))
    rows = rows.select(F.col(f"_c{at(id_col)}").alias("_id"), *[F.col(f"_c{at(c)}").alias(n) for n, c in zip(carried, carry, strict=True)], text.alias("_text"), F.octet_length(text).alias("_len"))
    of_length, of_prefix = F.xxhash64("_len"), F.xxhash64("_len", "_prefix")
    prefix, full = F.xxhash64(ascii_lower(F.substring("_text", 1, prefix_chars))), F.sha2(ascii_lower("_text").cast("binary"), 256)
    several = lambda df, *by: df.groupBy(*by).agg(F.count("*").alias("_n")).where("_n > 1")

    lengths = stored(membership(several(rows, "_len").select(of_length.alias("_h")), words=filter_words), "lengths", filter_words)
    keyed = may_hold(rows.select("_len", "_text"), lengths, of_length, words=filter_words).where("_may").select("_len", prefix.alias("_prefix"))
    prefixes = stored(membership(several(keyed, "_len", "_prefix").select(of_prefix.alias("_h")), words=filter_words), "prefixes", filter_words)
    left = may_hold(may_hold(rows, lengths, of_length, "_same_length", filter_words).withColumn("_prefix", F.when(F.col("_same_length"), prefix)), prefixes, of_prefix, words=filter_words)
    narrow = stored(left.select("_id", *carried, F.when(F.col("_same_length") & F.col("_may"), full).alias("_full")), "hashes")

    open_ = narrow.where("_full is not null")
    groups = stored(open_.groupBy("_full").agg(F.max("_id").alias("_keep"), F.count("*").alias("_size")), "groups", narrow.count())
    total = groups.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]
    alone = narrow.where("_full is null").select("*", F.col("_id").alias("_keep"), F.lit(1).cast("bigint").alias("_size"))
    out = split_join(open_, groups, ["_full"], "_size", total).unionByName(alone)
    return out.select(
        F.col("_id").alias(id_col), *[F.col(n).alias(c) for n, c in zip(carried, carry, strict=True)],
        F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"), F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"), F.col("_full").alias("full_hash"),
    )


def op8_exact_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("text_sha256", F.sha2(ascii_lower(F.coalesce("text", F.lit(""))).cast("binary"), 256))
    return exact_dedup(docs, carry=("text_sha256",)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
