"""Shared column rules of the training-data operators."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text is divisible by 5; a null id counts as the empty text, whose crc32 is 0."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def positional(docs: DataFrame) -> DataFrame:
    """docs with columns _c0, _c1, ...: what an operator adds can't clash, whatever docs' names are."""
    return docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])


def named(df: DataFrame, names: list[str], added: dict[str, Column]) -> DataFrame:
    """A positional frame under its own names again, with added columns; one of the same name is replaced."""
    return df.select(*[F.col(f"_c{i}").alias(n) for i, n in enumerate(names) if n not in added], *[c.alias(n) for n, c in added.items()])


def stand_ins(docs: DataFrame, *cols: str) -> list[Column]:
    """The columns of ``positional(docs)`` that stand for cols."""
    return [F.col(f"_c{docs.columns.index(c)}") for c in cols]


#: A membership filter has at most so many 64-bit words: 2^26 bits, a broadcast of some 50 MB at the most.
FILTER_WORDS = 1 << 20


def _word(h: Column, words: int) -> Column:
    return F.pmod(F.shiftright(h, 6), F.lit(words))


def _bit(h: Column) -> Column:
    return h.bitwiseAND(F.lit(63)).cast("int")


def membership(hashes: DataFrame, col: str = "_h", words: int = FILTER_WORDS) -> DataFrame:
    """Hashes as a filter (_word, _bits) of at most ``words`` rows, however many hashes there are."""
    h = F.col(col)
    return hashes.groupBy(_word(h, words).alias("_word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({col} & 63 as int))")).alias("_bits"))


def may_hold(rows: DataFrame, filter_: DataFrame, h: Column, flag: str = "_may", words: int = FILTER_WORDS) -> DataFrame:
    """rows + flag: false if h is surely none of the filter's hashes; true for all of them and, once they are
    many, for some others too. The filter's size is bounded by construction, so it is broadcast; rows stay
    where they are."""
    f = filter_.select(F.col("_word").alias("_fw"), F.col("_bits").alias("_fb"))
    out = rows.withColumn("_fh", h).join(F.broadcast(f), _word(F.col("_fh"), words) == F.col("_fw"), "left")
    return out.withColumn(flag, F.coalesce(F.getbit("_fb", _bit(F.col("_fh"))) == 1, F.lit(False))).drop("_fh", "_fw", "_fb")


#: A key with more than this share of the rows is hot; so fewer than 1024 keys are.
HOT_SHARE = 1024
#: So many narrow rows, some tens of MB, are no burden for one task, whatever their keys.
SMALL_ROWS = 1_000_000


def split_join(rows: DataFrame, per_key: DataFrame, key: list[str], n: str, total: int, how: str = "inner", small: int = 0) -> DataFrame:
    """rows, stored and narrow, joined with per_key, which has one row for each key and says in n how many of the
    ``total`` rows have it. Hot keys, fewer than HOT_SHARE by arithmetic, are known to the rows by broadcast and
    dealt to several tasks each, so none of them makes a task large. Where all rows together are at most
    ``small``, a plain join does."""
    if total <= small:
        return rows.join(per_key, key, how)
    least = max(1.0, total / HOT_SHARE)
    parts = F.when(F.col(n) > least, F.ceil(F.col(n) / least)).otherwise(1).cast("bigint")
    hot = per_key.where(F.col(n) > least).select(*key, parts.alias("_parts"))
    left = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.coalesce("_parts", F.lit(1).cast("bigint")))).drop("_parts")
    right = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)))
    return left.join(right, [*key, "_salt"], how).drop("_salt")


def split_text_join(rows: DataFrame, per_key: DataFrame, key: list[str], n: str, total: int, how: str = "inner") -> DataFrame:
    """As split_join for rows with texts: those of hot keys are joined by broadcast and stay where they are."""
    least = total / HOT_SHARE
    hot, cold = per_key.where(F.col(n) > least), per_key.where(F.col(n) <= least)
    a = rows.join(F.broadcast(hot), key)
    b = rows.join(F.broadcast(hot.select(*key)), key, "left_anti").join(cold, key, how)
    return a.unionByName(b)


def shipped_model(spark, path: str, build):
    """A function that gives executors build(the file's bytes), once per worker. The file is read here: on a
    cluster its path need not exist elsewhere."""
    import hashlib

    with open(path, "rb") as f:
        raw = f.read()
    key, shared = (build.__module__, hashlib.sha256(raw).hexdigest()), spark.sparkContext.broadcast(raw)  # a vocabulary file, a few MB

    return lambda: held_model(key, lambda: build(shared.value))


_HELD: list = [None, None]


def held_model(key, build):
    """What build() gives, kept from task to task; a worker holds that of one key only."""
    if _HELD[0] != key:
        _HELD[:] = [None, None]
        _HELD[:] = [key, build()]
    return _HELD[1]


def give_back() -> None:
    """Memory that this process no longer uses goes back to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: it keeps its own counsel


def trimmed(run):
    """run, an Arrow mapping, whose worker gives memory that it no longer uses back when the task ends:
    workers wait for their next task with what they hold."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped
