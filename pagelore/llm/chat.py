"""Chat formatting of logged conversations, cumulative snapshots collapsed first.

Logs repeat a conversation each time it grows. Every turn gets a rolling hash of all turns up to it: running
sums, over one window per conversation, of 64-bit hashes of (position, role, text), in two independent
halves each, so that 128 bits decide. A conversation is a snapshot if the hash of its last turn is the
hash of an inner turn of a longer one; an anti-join on distinct hashes retains the maximal ones. Equal
conversations are one, by the least id. Only then texts are joined again and rendered. Native only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelore.runtime import stored, table

#: Fixed values of the chat markup.
START, END = "<|im_start|>", "<|im_end|>"


def numbered(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, k, role, text): turns by position from 1. Order is by turn number, then role, then text,
    nulls last; rows repeated in all four count once; null text is empty, null role is 'unknown'."""
    t = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    w = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last(), F.col("text").asc_nulls_last())
    now = F.struct("turn", "role", "text")
    t = t.withColumn("_new", ~F.coalesce(F.lag(now).over(w).eqNullSafe(now), F.lit(False))).where("_new")
    return t.select("conv", F.row_number().over(w).alias("k"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """numbered turns -> (conv, k, n, p1, p2): of each turn its position, the number of turns, and the
    hash of all turns up to it."""
    w = Window.partitionBy("conv").orderBy("k")
    a, b = F.xxhash64("k", "role", "text"), F.xxhash64(F.lit("b"), "text", "role", "k")
    low, high = lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF)), lambda h: F.shiftrightunsigned(h, 32)
    h = turns.select("conv", "k", *[f(x).alias(n) for n, f, x in (("a1", low, a), ("a2", high, a), ("b1", low, b), ("b2", high, b))])
    h = h.select("conv", "k", F.count("*").over(Window.partitionBy("conv")).alias("n"), *[F.sum(c).over(w).alias(c) for c in ("a1", "a2", "b1", "b2")])
    return h.select("conv", "k", "n", F.xxhash64("k", "a1", "a2").alias("p1"), F.xxhash64("k", "b1", "b2").alias("p2"))


def maximal(hashes: DataFrame) -> DataFrame:
    """(conv, n, copies) of the conversations that prefix no longer one; of equal ones the least id (null
    only if none has another), copies counts them."""
    whole = hashes.where("k = n").groupBy("k", "p1", "p2").agg(F.min("conv").alias("conv"), F.max(F.col("n")).alias("n"), F.count("*").alias("copies"))
    inner = hashes.where("k < n").select("k", "p1", "p2").distinct()
    return whole.join(inner, ["k", "p1", "p2"], "left_anti").select("conv", "n", "copies")


def rendered_turn(role, text):
    """One turn in the markup. Markers inside role or text get a space, so that a turn can't end early."""
    plain = lambda c: F.replace(F.replace(c, F.lit(START), F.lit("<| im_start|>")), F.lit(END), F.lit("<| im_end|>"))
    return F.concat(F.lit(START), plain(role), F.lit("\n"), plain(text), F.lit(END + "\n"))


def format_chats(turns: DataFrame, **cols) -> DataFrame:
    """(conv_id, n_turns, copies, chat) of each maximal conversation. Rows of the null id are one
    conversation. Columns other than the four are not read, whatever their names; long texts are kept whole. An
    empty table gives an empty result. A rendered conversation is one row."""
    t = stored(numbered(turns, **cols), "turns")
    keep = stored(maximal(stored(prefix_hashes(t), "prefixes")), "maximal")
    # Join and grouping have the same keys without nulls, so texts are dealt out once.
    own = lambda df: df.withColumn("_null", F.col("conv").isNull()).withColumn("_conv", F.coalesce(F.col("conv").cast("string"), F.lit("")))
    t = own(t).join(own(keep).select("_null", "_conv", "n", "copies").hint("merge"), ["_null", "_conv"])
    said = F.collect_list(F.struct("k", rendered_turn(F.col("role"), F.col("text")).alias("s")))
    chat = F.array_join(F.transform(F.sort_array(said), lambda x: x["s"]), "")
    g = t.groupBy("_null", "_conv").agg(F.first("conv").alias("conv_id"), F.first("n").alias("n_turns"), F.first("copies").alias("copies"), chat.alias("chat"))
    return g.select("conv_id", "n_turns", "copies", "chat")


def op3_chat_format(spark, sf_dir):
    return format_chats(table(spark, sf_dir, "conversations"))


SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
k AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS LAST, text NULLS LAST) AS k, count(*) OVER (PARTITION BY conv_id) AS n,
             '<|im_start|>' || replace(replace(coalesce(role, 'unknown'), '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>') || chr(10)
             || replace(replace(coalesce(text, ''), '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>') || '<|im_end|>' || chr(10) AS s FROM t),
p AS (SELECT conv_id, k, n, string_agg(s, '') OVER (PARTITION BY conv_id ORDER BY k) AS chat FROM k),
w AS (SELECT min(conv_id) AS conv_id, max(n) AS n_turns, count(*) AS copies, chat FROM p WHERE k = n GROUP BY chat)
SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.k < p.n AND p.chat = w.chat)
"""
