"""Line deduplication: hashes range-partitioned with a secondary sort, decisions as keep bitmaps.

Pass 1 turns every line into (128-bit key hash, document, position). The rows are range-partitioned and
sorted by hash, then document, then position; as document and position are part of the partitioning key,
a line that a third of all documents share is spread over many partitions. The sorted rows are
checkpointed. A hash cut by a partition border is known by at most two rows a partition: its number
of documents and its first partition are looked up for these border hashes alone. Pass 2 streams the
sorted partitions, holding no more than one open run of too few documents, and emits the positions
to drop. These become one zlib-compressed bitmap per document; texts are rewritten by joining bitmaps, those
of documents that lose no line are not moved.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from pagelore.llm.common import may_hold, membership, positional, split_text_join, trimmed
from pagelore.runtime import cut, stored, table

LINES = "h1 bigint, h2 bigint, doc bigint, th bigint, pos int, n_lines int"
BITMAPS = "doc bigint, th bigint, n_rows bigint, n_lines int, n_dropped int, keep binary"
STRIP = b" \t\n\x0b\x0c\r"


def _text_hash(text):
    """Tells apart rows of one id with different texts."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _keys(raw: bytes, min_chars: int):
    """(position, key) of each line whose key has min_chars code points."""
    for pos, line in enumerate(raw.lower().split(b"\n")):
        key = line.strip(STRIP)
        if len(key) >= min_chars and (min_chars <= 1 or len(key.decode()) >= min_chars):
            yield pos, key


def _lines(min_chars: int):
    def run(batches):
        import xxhash

        for b in batches:
            out = [[] for _ in range(5)]
            digests = bytearray()
            for doc, th, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                raw = (text or "").encode()
                n = raw.count(b"\n") + 1
                for pos, key in _keys(raw, min_chars):
                    digests += xxhash.xxh3_128_digest(key)
                    for c, v in zip(out[1:], (doc, th, pos, n), strict=True):
                        c.append(v)
            h = np.frombuffer(bytes(digests), dtype="<i8").reshape(-1, 2)
            doc, th, pos, n = out[1:]
            yield pa.record_batch([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(doc, pa.int64()), pa.array(th, pa.int64()), pa.array(pos, pa.int32()), pa.array(n, pa.int32())], names=["h1", "h2", "doc", "th", "pos", "n_lines"])

    return run


def _stream(min_docs: int, keep_first: bool, border: dict):
    """Sorted rows -> rows to drop. border: hash -> (documents, first partition) of hashes that borders cut."""

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held, open_key = [], None  # rows of the open run; the hash of an open run whose rows have gone on, as it has enough documents

        def dropped(rows, first_known):
            """Of whole runs: those of enough documents, without the first row if that stays."""
            h1, h2, doc, null = rows["h1"], rows["h2"], rows["doc"], rows["null"]
            new = np.ones(len(h1), bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            new_doc = new.copy()
            new_doc[1:] |= (doc[1:] != doc[:-1]) | (null[1:] != null[:-1])
            run_id = np.cumsum(new) - 1
            docs = np.bincount(run_id, weights=new_doc).astype(np.int64)
            starts = np.flatnonzero(new)
            first = new.copy()
            for k in {0, len(starts) - 1}:  # only the first and last run of a partition can be cut
                total, first_part = border.get((int(h1[starts[k]]), int(h2[starts[k]])), (None, part))
                if total is not None:
                    docs[k] = total
                    first[starts[k]] &= first_part == part
            if first_known:  # the run began in rows that have gone on already
                first[0] = False
                docs[0] = max(docs[0], min_docs)
            take = docs[run_id] >= min_docs
            if keep_first:
                take &= ~first
            return {k: v[take] for k, v in rows.items()}

        def batch(rows):
            return pa.record_batch([pa.array(rows["doc"], mask=rows["null"]), pa.array(rows["th"]), pa.array(rows["pos"]), pa.array(rows["n_lines"])], names=["doc", "th", "pos", "n_lines"])

        for b in batches:
            if not b.num_rows:
                continue
            doc = b.column(2)
            rows = {"h1": b.column(0).to_numpy(), "h2": b.column(1).to_numpy(), "doc": doc.fill_null(0).to_numpy(), "null": np.asarray(doc.is_null()), "th": b.column(3).to_numpy(), "pos": b.column(4).to_numpy(), "n_lines": b.column(5).to_numpy()}
            if held:
                rows = {k: np.concatenate([held[k], v]) for k, v in rows.items()}
            last = (int(rows["h1"][-1]), int(rows["h2"][-1]))
            begins = int(np.flatnonzero((rows["h1"] != last[0]) | (rows["h2"] != last[1]))[-1]) + 1 if (rows["h1"][0], rows["h2"][0]) != last else 0
            known_here = (int(rows["h1"][0]), int(rows["h2"][0])) == open_key
            known = known_here and begins == 0
            # The last run stays open unless it is sure to be dropped already.
            tail = {k: v[begins:] for k, v in rows.items()}
            enough = known or border.get(last, (0, 0))[0] >= min_docs or len(np.unique(tail["doc"])) >= min_docs
            upto = len(rows["h1"]) if enough else begins
            if upto:
                out = dropped({k: v[:upto] for k, v in rows.items()}, known_here)
                if len(out["doc"]):
                    yield batch(out)
            open_key, held = last if enough else None, {} if enough else tail
        if held:
            out = dropped(held, False)
            if len(out["doc"]):
                yield batch(out)

    return run


def _bitmaps(batches):
    for b in batches:
        keep, dropped = [], []
        for n, pos in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
            bits = np.ones(n, np.uint8)
            bits[pos] = 0
            keep.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 6))
            dropped.append(len(pos))
        yield pa.record_batch([*(b.column(i) for i in range(4)), pa.array(dropped, pa.int32()), pa.array(keep, pa.binary())], names=["doc", "th", "n_rows", "n_lines", "n_dropped", "keep"])


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 2, min_chars: int = 1, keep_first: bool = True) -> DataFrame:
    """(doc, th, n_rows, n_lines, n_dropped, keep) of each document that loses a line; the others keep all.

    A line's key is the line without [\\x20\\x09-\\x0D] at its ends, A-Z lower-cased. Keys of at least
    min_chars code points found in at least min_docs documents lose their lines; with keep_first the
    first of them, by document and position, stays. keep is a zlib-compressed little-endian bitmap of
    the lines that stay. th tells apart rows of one id with different texts; repeated rows share a
    bitmap (n_rows counts them), and rows of one id, or of the null id, count as one document. A null text is
    one empty line. Ids are whole numbers: others fail. Other columns are not read, whatever their names.
    Empty tables give no bitmaps.
    """
    i, t = (F.col(f"_c{docs.columns.index(c)}") for c in (id_col, text_col))
    rows = positional(docs).select(i.cast("bigint").alias("doc"), _text_hash(t).alias("th"), t.alias("text")).mapInArrow(trimmed(_lines(min_chars)), LINES)
    key = ["h1", "h2", "doc", "th", "pos"]
    rows = cut(rows.repartitionByRange(*key).sortWithinPartitions(*key))
    ends = rows.groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct("h1", "h2")).alias("a"), F.max(F.struct("h1", "h2")).alias("b"))
    # Hashes at both sides of a border: at most one a border, so as many as partitions.
    ends = sorted((r.part, tuple(r.a), tuple(r.b)) for r in ends.collect())
    cut_by = {b for (_, _, b), (_, a, _) in zip(ends, ends[1:], strict=False) if a == b}
    border: dict = {}
    if cut_by:
        keys = docs.sparkSession.createDataFrame([(*k,) for k in cut_by], "h1 bigint, h2 bigint")
        of = rows.withColumn("part", F.spark_partition_id()).join(F.broadcast(keys), ["h1", "h2"]).groupBy("h1", "h2", "doc").agg(F.min("part").alias("part"))
        border = {(r.h1, r.h2): (r.n, r.part) for r in of.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("part").alias("part")).collect()}
    drops = rows.mapInArrow(trimmed(_stream(min_docs, keep_first, border)), "doc bigint, th bigint, pos int, n_lines int")
    per_doc = drops.groupBy("doc", "th").agg(F.count("*").alias("n"), F.first("n_lines").alias("n_lines"), F.sort_array(F.collect_set("pos")).alias("pos"))
    return per_doc.select("doc", "th", F.ceil(F.col("n") / F.size("pos")).alias("n_rows"), "n_lines", "pos").mapInArrow(trimmed(_bitmaps), BITMAPS)


def _rewritten(docs: DataFrame, bitmaps: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """positional(docs) + _n_lines, _n_dropped, _kept. Only documents that a membership filter of bounded size
    takes for one with a bitmap meet the bitmaps; the others keep their text where it is."""

    def rewrite(batches):
        for b in batches:
            text, keep = (b.column(b.schema.names.index(c)).to_pylist() for c in ("_text", "_keep"))
            kept = []
            for t, k in zip(text, keep, strict=True):
                parts = (t or "").split("\n")
                if k is not None:
                    bits = np.unpackbits(np.frombuffer(zlib.decompress(k), np.uint8), count=len(parts), bitorder="little")
                    parts = [p for p, bit in zip(parts, bits.tolist(), strict=True) if bit]
                kept.append("\n".join(parts))
            cols = [c for c, n in zip(b.columns, b.schema.names, strict=True) if n not in ("_text", "_keep")]
            yield pa.record_batch([*cols, pa.array(kept, pa.string())], schema=pa.schema([*[f for f in b.schema if f.name not in ("_text", "_keep")], ("_kept", pa.string())]))

    i, t = (F.col(f"_c{docs.columns.index(c)}") for c in (id_col, text_col))
    bitmaps = stored(bitmaps, "bitmaps")
    own = lambda doc: [F.coalesce(doc, F.lit(0)).alias("_doc"), doc.isNull().alias("_null")]
    hashed = lambda doc, th: F.xxhash64(doc, th)
    n_lines = F.length(F.coalesce(t, F.lit(""))) - F.length(F.replace(F.coalesce(t, F.lit("")), F.lit("\n"), F.lit(""))) + 1
    rows = positional(docs).withColumn("_th", _text_hash(t)).withColumn("_n_lines", n_lines.cast("bigint"))
    rows = may_hold(rows, membership(bitmaps.select(hashed(F.col("doc"), F.col("th")).alias("_h"))), hashed(i.cast("bigint"), F.col("_th")))
    whole = rows.where(~F.col("_may")).withColumn("_n_dropped", F.lit(0).cast("bigint")).withColumn("_kept", F.coalesce(t, F.lit(""))).drop("_th", "_may")
    total = bitmaps.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
    per_key = bitmaps.select(*own(F.col("doc")), F.col("th").alias("_th"), "n_rows", F.col("keep").alias("_keep"), F.col("n_dropped").cast("bigint").alias("_n_dropped"))
    some = rows.where("_may").select("*", *own(i.cast("bigint")), t.alias("_text"))
    some = split_text_join(some, per_key, ["_doc", "_null", "_th"], "n_rows", total, "left")
    some = some.select(*[f"_c{k}" for k in range(len(docs.columns))], "_n_lines", F.coalesce("_n_dropped", F.lit(0).cast("bigint")).alias("_n_dropped"), "_text", "_keep")
    schema = StructType([f for f in some.schema.fields if f.name not in ("_text", "_keep")]).add("_kept", StringType())
    return whole.unionByName(some.mapInArrow(trimmed(rewrite), schema))


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without text_col + _n_lines, _n_dropped, _kept: the text of the lines that stay, joined by \n. Columns of
    these names are replaced. Null text is one empty line, kept as the empty text. Repeated rows stay repeated."""
    out = _rewritten(docs, bitmaps, id_col, text_col)
    names = [(k, c) for k, c in enumerate(docs.columns) if c not in (text_col, "_n_lines", "_n_dropped", "_kept")]
    return out.select(*[F.col(f"_c{k}").alias(c) for k, c in names], "_n_lines", "_n_dropped", "_kept")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: float = 1.0, **rule) -> DataFrame:
    """docs with their texts rewritten by ``keep_bitmaps``; the same columns, a null text stays null.
    No row is dropped: a document whose lines all go has the empty text. A document that would lose
    more than the share ``most`` of its lines is left as it is: it is a copy, for a later step to judge whole."""
    bitmaps = keep_bitmaps(docs, id_col, text_col, **rule).where(F.col("n_dropped") <= most * F.col("n_lines"))
    out, at = _rewritten(docs, bitmaps, id_col, text_col), docs.columns.index(text_col)
    text = F.when(F.col(f"_c{at}").isNotNull(), F.col("_kept"))
    return out.select(*[(text if k == at else F.col(f"_c{k}")).alias(c) for k, c in enumerate(docs.columns)])


def op2_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = with_bitmaps(docs, keep_bitmaps(docs, min_docs=10, min_chars=1, keep_first=False))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.col("_kept").cast("binary"), 256).alias("kept_sha256"))


SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT k.doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY k.doc_id
"""
