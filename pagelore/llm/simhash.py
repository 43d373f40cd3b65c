"""SimHash near-deduplication with deletion-variant signatures.

Fingerprints are cut into so few segments that of two within ``radius`` bits, one segment differs by at
most one bit: segments = (radius + 2) // 2. Each segment is indexed once for each of its bits with that
bit deleted; two fingerprints within the radius share such a variant, so equality on variants finds every
link, and candidates are verified on all 64 bits.

Only distinct fingerprints are indexed, so copies cost one row. Within a bucket (one variant) links are
not expanded into pairs: fingerprints are linked to the first of the bucket's own components, so a bucket
gives fewer links than it has members. Chance members are the most by far: buckets of a few are first searched
for any close pair, all at once. Buckets of up to ``bucket_cap`` members are verified in one task. A larger
bucket is not cut short. With a radius of 2 its members go on to a second index, whose keys delete two bits
at once; there equality alone proves a link, so any number of members are linked to their least by a plain
aggregation. With a larger radius they are dealt to blocks, and each pair of blocks is verified in a task.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelore.llm.common import split_join, trimmed
from pagelore.llm.components import components
from pagelore.runtime import FILE_ROWS, stored, table

BITS = 64


def fingerprint(text: str | None, words: int) -> int:
    """SimHash of the text's word shingles: A-Z lower-cased, words split at [\\x20\\x09-\\x0D], repeats
    counted, XXH64 with seed 42; a bit is set if more than half of the hashes have it. 0 without words."""
    import xxhash

    w = (text or "").encode().lower().split()
    if not w:
        return 0
    if len(w) <= words:
        return xxhash.xxh64_intdigest(b" ".join(w), 42)
    h64, join = xxhash.xxh64_intdigest, b" ".join
    h = np.fromiter((h64(join(s), 42) for s in zip(*[w[i:] for i in range(words)], strict=False)), np.uint64, len(w) - words + 1)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp): fp is the fingerprint's bits as a signed bigint."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.record_batch([b.column(0), pa.array(fp, pa.int64())], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(trimmed(run), "id bigint, fp bigint")


def segments_for(radius: int) -> list[tuple[int, int]]:
    """(shift, width) of the fewest segments of which one differs by at most a bit."""
    n = (radius + 2) // 2
    ends = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]


def _variants(segments):
    masks = []
    for s, (shift, width) in enumerate(segments):
        seg = ((1 << width) - 1) << shift
        masks += [(s, i, seg & ~(1 << (shift + i))) for i in range(width)]

    def run(batches):
        for b in batches:
            fp = b.column(0).to_numpy().view(np.uint64)
            for s, i, mask in masks:
                # The kept bits of the segment are below 2^32 after the shift; the variant's number goes above them.
                key = ((fp & np.uint64(mask)) >> np.uint64(segments[s][0])) | np.uint64((s * BITS + i) << 48 if segments[s][1] <= 48 else 0)
                if segments[s][1] > 48:  # one segment only: mix its variant in
                    key ^= np.uint64((i * 0x9E3779B97F4A7C15) & (2**64 - 1))
                yield pa.record_batch([pa.array(key.view(np.int64)), b.column(0)], names=["key", "fp"])

    return run


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which rows of 64-bit words differ."""
    x = np.bitwise_count(a ^ b)
    return x[..., 0] if x.shape[-1] == 1 else x.sum(axis=-1)


def _local_links(fp: np.ndarray, radius: int):
    """Links of positions that join what lies within the radius, each to the first of its component."""
    n, todo = len(fp), np.ones(len(fp), bool)
    for i in range(n):
        if not todo[i]:
            continue
        todo[i] = False
        front = [i]
        while front:  # breadth first: each member is compared with all once
            at = front.pop()
            rest = np.flatnonzero(todo)
            near = rest[apart(fp[rest], fp[at]) <= radius]
            todo[near] = False
            front += near.tolist()
            for j in near.tolist():
                yield i, j


#: Buckets of up to so many members are searched together for any close pair.
FEW = 48


def _close_buckets(keys: np.ndarray, fp: np.ndarray, start: np.ndarray, sizes: np.ndarray, radius: int) -> np.ndarray:
    """Which buckets may hold a pair within the radius: of those with a few members, those that do."""
    few = (sizes > 1) & (sizes <= FEW)
    rows = np.flatnonzero(np.repeat(few, sizes))
    bucket = np.repeat(np.arange(len(start)), sizes)[rows]
    x, close = fp[rows], np.zeros(len(start), bool)
    for d in range(1, min(FEW, len(rows))):
        same = bucket[d:] == bucket[:-d]
        if not same.any():
            break
        near = same & (apart(x[d:], x[:-d]) <= radius)
        close[bucket[d:][near]] = True
    return np.flatnonzero(close | (sizes > FEW))


def _bucket_links(radius: int, cap: int):
    """Rows (key, fp) sorted by key, whose id is fp, or (key, fp, fq, id) -> links (key, a, b) of ids; of buckets
    above the cap their members, as (key, id, null, fp, fq). fq: 64 more bits that count."""

    def run(batches):
        none = np.zeros(0, np.int64)
        keys, fps, ids, over, over_key = none, None, none, False, None

        def batch(key, a, b=None, fp=None):
            of = lambda x: pa.nulls(len(a), pa.int64()) if x is None else pa.array(np.ascontiguousarray(x).view(np.int64))
            return pa.record_batch([pa.array(np.full(len(a), key, np.int64)), pa.array(a), of(b), of(None if fp is None else fp[:, 0]), of(None if fp is None else fp[:, -1])], names=["key", "a", "b", "fp", "fq"])

        def done(keys, fps, ids):
            if not len(keys):
                return
            start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            sizes = np.diff(np.r_[start, len(keys)])
            links = []
            for k in _close_buckets(keys, fps, start, sizes, radius).tolist():
                s, n = start[k], sizes[k]
                if n > cap:
                    yield batch(keys[s], ids[s : s + n], fp=fps[s : s + n])
                else:
                    links += [(s + i, s + j) for i, j in _local_links(fps[s : s + n], radius)]
            if links:
                m = ids[np.array(links)]
                yield batch(0, m[:, 0].copy(), m[:, 1].copy())

        for r in batches:
            k = r.column(0).to_numpy()
            f = np.stack([r.column(c).to_numpy().view(np.uint64) for c in ((1, 2) if r.num_columns > 2 else (1,))], axis=1)
            i = r.column(3).to_numpy() if r.num_columns > 2 else r.column(1).to_numpy()
            if over:  # the bucket that is too large goes on
                n = int(np.argmax(k != over_key)) if (k != over_key).any() else len(k)
                if n:
                    yield batch(over_key, i[:n], fp=f[:n])
                k, f, i = k[n:], f[n:], i[n:]
                if not len(k):
                    continue
                over = False
            if not len(k):
                continue
            keys, fps, ids = np.concatenate([keys, k]), f if fps is None else np.concatenate([fps, f]), np.concatenate([ids, i])
            cut = int(np.searchsorted(keys, keys[-1]))
            yield from done(keys[:cut], fps[:cut], ids[:cut])
            keys, fps, ids = keys[cut:], fps[cut:], ids[cut:]
            if len(keys) > cap:
                yield batch(keys[-1], ids, fp=fps)
                over, over_key, keys, fps, ids = True, keys[-1], none, None, none
        yield from done(keys, fps, ids)

    return run


LINKS = "key bigint, a bigint, b bigint, fp bigint, fq bigint"


def _two_bit_links(crowded: DataFrame, radius: int) -> DataFrame:
    """Every pair within the radius agrees on all but some ``radius`` bits: equal there, equal for good."""
    masks = [sum(1 << i for i in c) for c in combinations(range(BITS), radius)]
    table_ = F.array(*[F.lit(~m if m < 2**63 else ~m + 2**64) for m in masks])
    keyed = crowded.select("fp").distinct().select("fp", F.posexplode(table_).alias("v", "mask")).select("v", F.col("fp").bitwiseAND(F.col("mask")).alias("k"), "fp")
    least = keyed.groupBy("v", "k").agg(F.min("fp").alias("m"), F.max("fp").alias("x")).where("m <> x")
    return keyed.join(least.drop("x"), ["v", "k"]).where("fp <> m").select(F.col("m").alias("a"), F.col("fp").alias("b")).distinct()


def _block_links(crowded: DataFrame, radius: int, cap: int) -> DataFrame:
    """Members of large buckets in blocks of about half the cap: each pair of blocks of a bucket is one group."""
    n = crowded.groupBy("key").agg(F.ceil(2 * F.count("*") / cap).cast("bigint").alias("blocks"))
    x = crowded.select("key", "fp", "fq", F.col("a").alias("id")).join(n, "key").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
    x = x.select("key", "fp", "fq", "id", "own", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other"))
    # Two groups whose hashes meet are verified together: more comparisons, the same links.
    x = x.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "fp", "fq", "id")
    return x.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(trimmed(_bucket_links(radius, 1 << 40)), LINKS).select("a", "b")


#: Rows of an index that a task makes out of its fingerprints, about: 64 MB of shuffle output.
TASK_ROWS = 1 << 22


def fingerprint_links(distinct: DataFrame, radius: int = 2, bucket_cap: int = 4096) -> DataFrame:
    """distinct (fp) -> links (a, b) whose components are those of all pairs within the radius."""
    some = distinct.select("fp").repartition(1 + distinct.count() * BITS // TASK_ROWS)
    rows = some.mapInArrow(_variants(segments_for(radius)), "key bigint, fp bigint")
    found = stored(rows.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(trimmed(_bucket_links(radius, bucket_cap)), LINKS), "found")
    links, crowded = found.where("b is not null").select("a", "b"), found.where("b is null")
    if crowded.isEmpty():
        return links.distinct().coalesce(1 + found.count() // FILE_ROWS)
    return links.union(_two_bit_links(crowded, radius) if radius <= 2 else _block_links(crowded.withColumn("fq", F.lit(0).cast("bigint")), radius, bucket_cap)).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2, bucket_cap: int = 4096) -> DataFrame:
    """(id, fp, component) of each row: component is the smallest id that links reach, its own included.

    Rows are linked if their fingerprints differ in at most ``radius`` bits; equal fingerprints, those
    of texts without words (null, empty or white space: 0) included, differ in none. Null ids take part
    and get a component; they never name one unless all ids of it are null. Repeated rows give
    repeated rows. Ids are whole numbers: others fail. Only the two columns are read, whatever the names of
    the others. An empty table gives an empty result.
    """
    prints = stored(fingerprints(docs, id_col, text_col, words), "prints")
    distinct = stored(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "distinct", prints.count())
    total = distinct.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    links = stored(fingerprint_links(distinct, radius, bucket_cap), "links")
    n = links.count()
    roots = components(links, at_most=n)
    roots = stored(roots.select(F.col("node").alias("fp"), "root"), "roots", 2 * n)
    named = distinct.join(roots, "fp").groupBy("root").agg(F.min("least").alias("component"))
    classes = distinct.join(roots.join(named, "root").select("fp", "component"), "fp", "left").select("fp", "n", F.coalesce("component", "least").alias("component"))
    return split_join(prints, stored(classes, "classes", total), ["fp"], "n", total).select("id", "fp", "component")


def op5_simhash_dedup(spark, sf_dir):
    out = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
