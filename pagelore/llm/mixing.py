"""Mixing sources to target weights by hash-threshold histograms.

Every document has a 60-bit hash. Words are summed by source and by the top 12 bits; running sums over
at most 4096 buckets find the bucket in which a source's budget ends. Only that boundary bucket is
refined: by the next 12 bits, and at last by the exact hash. A document is then taken or not by
comparing its hash with its source's threshold: nothing is sorted but histograms. All histograms are
partial sums on the map side, so a source with a third of all rows costs 4096 rows per task. Native only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelore.llm.common import positional, split_text_join
from pagelore.runtime import stored, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
HASH_BITS, STEP_BITS = 60, 12


def word_count(c):
    """Maximal runs of characters other than space and \\t..\\r; null has none."""
    return F.coalesce(F.regexp_count(c, F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size) -> + target. Sources in code point order, null last, take the weights in
    turn. share x all words is dealt by weight; a target stops at cap x its source, and the excess is
    dealt again by weight until none is above. That is one water level: target = least(cap x size,
    weight x level). Sources sorted by cap x size / weight fill up one after the other; the level is
    the first at which all those before are full and this one is not. One row per source is held."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    total, full = Window.partitionBy(), Window.orderBy(F.col("_at"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("_w", w).withColumn("_at", cap * F.col("source_size") / F.col("_w"))
    s = s.withColumn("_all", F.sum("source_size").over(total)).withColumn("_allw", F.sum("_w").over(total))
    s = s.withColumn("_level", (share * F.col("_all") - F.coalesce(F.sum(cap * F.col("source_size")).over(full), F.lit(0))) / (F.col("_allw") - F.coalesce(F.sum("_w").over(full), F.lit(0))))
    s = s.withColumn("_turn", F.row_number().over(Window.orderBy(F.col("_at"), F.col("source").asc_nulls_last())))
    s = s.withColumn("_level", F.min_by("_level", F.when(F.col("_level") <= F.col("_at"), F.col("_turn"))).over(total))
    more = [c for c in sizes.columns if c not in ("source", "source_size")]
    return s.select("source", "source_size", *more, F.least(cap * F.col("source_size").cast("double"), F.col("_w") * F.col("_level")).alias("target"))


def _names(df: DataFrame) -> DataFrame:
    """source as two columns that join nulls as equal."""
    return df.withColumn("_null", F.col("source").isNull()).withColumn("_src", F.coalesce("source", F.lit(""))).drop("source")


def _hash(id_, text):
    """Of id and text, so that rows that share an id, or have none, are not one block."""
    key = F.concat_ws("\n", F.coalesce(id_.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("bigint")


def mixing_plan(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """rows (source, size, _h), stored -> one row per source: source_size, target, the number of whole
    passes, the rest, the hash up to which documents are taken once more (null: all, if there is a rest) and
    the number of rows. A source's histogram is at most 4096 rows, rows themselves are joined by split_text_join."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_n"))
    targets = stored(source_targets(sizes, weights, share, cap), "targets")
    total = targets.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    passes = F.when(F.col("source_size") > 0, F.least(F.lit(cap), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("bigint")
    targets = targets.withColumn("_k", passes).withColumn("_rest", F.col("target") - F.col("_k") * F.col("source_size"))
    rows, open_ = _names(rows), _names(targets.where("_rest > 0")).select("_null", "_src", "_n", "_rest", F.lit(0).cast("bigint").alias("_low"), F.lit(0).cast("bigint").alias("_before"))
    # Each step: in the open bucket of each source, the sub-bucket in which the budget ends.
    for shift in (HASH_BITS - STEP_BITS, HASH_BITS - 2 * STEP_BITS, 0):
        width = F.lit(1 << shift).cast("bigint")
        inside = rows if shift == HASH_BITS - STEP_BITS else split_text_join(rows, open_.select("_null", "_src", "_n", F.col("_low").alias("_from"), (F.col("_low") + F.lit(1 << above)).alias("_to")), ["_null", "_src"], "_n", total).where("_h >= _from and _h < _to")
        hist = inside.groupBy("_null", "_src", (F.shiftright("_h", shift) * width).alias("_b")).agg(F.sum("size").alias("_s"))
        w = Window.partitionBy("_null", "_src").orderBy("_b")
        run = hist.join(open_, ["_null", "_src"]).withColumn("_upto", F.col("_before") + F.sum("_s").over(w))
        if shift:  # the first bucket whose end passes the rest; if none does, there is no rest to speak of
            end = run.where("_upto > _rest").groupBy("_null", "_src").agg(F.min_by(F.struct("_n", "_rest", F.col("_b").alias("_low"), (F.col("_upto") - F.col("_s")).alias("_before")), "_b").alias("_x"))
            open_ = stored(end.select("_null", "_src", "_x.*"), "boundary")
        else:  # exact hashes: the last one that is taken, at least half of it inside the rest
            end = run.groupBy("_null", "_src").agg(F.first("_low").alias("_low"), F.max(F.when(2 * F.col("_upto") - F.col("_s") <= 2 * F.col("_rest"), F.col("_b"))).alias("_last"))
            cuts = stored(end.select("_null", "_src", F.coalesce("_last", F.col("_low") - 1).alias("_cut")), "cuts")
        above = shift
    return stored(_names(targets).join(cuts, ["_null", "_src"], "left"), "plan")


def _take(rows: DataFrame, plan: DataFrame, cap: int) -> DataFrame:
    """rows (_null, _src, _h, ...) + the plan of their source and copies."""
    copies = F.least(F.lit(cap).cast("bigint"), F.col("_k") + F.when((F.col("_rest") > 0) & (F.col("_cut").isNull() | (F.col("_h") <= F.col("_cut"))), 1).otherwise(0))
    total = plan.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    return split_text_join(rows, plan, ["_null", "_src"], "_n", total).withColumn("copies", copies)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """One row per input row: id, size, source_size, target, copies, taken (= copies x size).

    A source whose target is k whole passes and a rest takes every document k times; the rest goes
    to the documents of least hash: those up to the threshold whose running sum is nearest to it.
    The hash is of id and text (md5, first 15 digits), so reruns agree and only rows that repeat both go
    together. Null text has size 0; null is a source of its own, as is the empty name; a null id hashes as ''.
    Ids may be of any type. Copies never exceed ``cap``. Other columns are not read, whatever their names. An
    empty table gives an empty result.
    """
    i, t, s = (docs.columns.index(c) for c in (id_col, text_col, source_col))
    c = [F.col(f"_c{k}") for k in range(len(docs.columns))]
    rows = stored(positional(docs).select(c[i].alias("_id"), c[s].alias("source"), word_count(c[t]).alias("size"), _hash(c[i], c[t]).alias("_h")), "sized")
    out = _take(_names(rows), mixing_plan(rows, weights, share, cap), cap)
    return out.select(F.col("_id").alias(id_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """The mix itself: docs with each row as often as ``mix`` says, the columns as they are. Texts
    stay where they are, those of sources with less than a thousandth of the rows excepted: the plan, a row
    per source, is joined to them."""
    i, t, s = (docs.columns.index(c) for c in (id_col, text_col, source_col))
    c = [F.col(f"_c{k}") for k in range(len(docs.columns))]
    rows = stored(positional(docs).select(c[s].alias("source"), word_count(c[t]).alias("size"), _hash(c[i], c[t]).alias("_h")), "sized")
    all_ = positional(docs).select(F.struct(*c).alias("_row"), c[s].alias("source"), _hash(c[i], c[t]).alias("_h"))
    out = _take(_names(all_), mixing_plan(rows, weights, share, cap), cap)
    out = out.select("_row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("_row.*")
    return out.toDF(*docs.columns)


def op4_mix_sources(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = """
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+'))::BIGINT AS size,
                      ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || chr(10) || coalesce(text, '')), 1, 15))::BIGINT AS h FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM sizes),
f AS (SELECT *, 2 * source_size / w AS full_at, sum(source_size) OVER () AS s_all, sum(w) OVER () AS w_all FROM w),
l AS (SELECT *, (1.5 * s_all::DOUBLE - coalesce(sum(2 * source_size) OVER p, 0)::DOUBLE) / (w_all - coalesce(sum(w) OVER p, 0))::DOUBLE AS level,
             row_number() OVER (ORDER BY full_at, source NULLS LAST) AS turn
      FROM f WINDOW p AS (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT arg_min(level, turn) AS level FROM l WHERE level <= full_at),
t AS (SELECT source, source_size, least(2 * source_size::DOUBLE, l.w * m.level) AS target FROM l, m),
k AS (SELECT *, CASE WHEN source_size > 0 THEN least(2, floor(target / source_size))::BIGINT ELSE 0 END AS k FROM t),
r AS (SELECT d.doc_id, d.size, k.source_size, k.target, k.k, k.target - k.k * k.source_size AS rest,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE UNBOUNDED PRECEDING) AS upto,
             sum(d.size) OVER (PARTITION BY d.source, d.h) AS tie
      FROM sized d JOIN k ON d.source IS NOT DISTINCT FROM k.source)
SELECT doc_id, size, source_size, target,
       (size * (k + CASE WHEN rest > 0 AND 2 * upto - tie <= 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""
