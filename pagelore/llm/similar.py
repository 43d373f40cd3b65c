"""Near duplicates by word shingles: SimHash deletion variants find candidates, exact sets decide.

The similarity of two texts is the Jaccard similarity of their sets of word shingles. A text has PRINTS
SimHash fingerprints of 64 bits, of one hash of each shingle mixed in as many ways. Each is cut into segments
of which one must differ by at most one bit, each segment is indexed once for each of its bits with that bit
deleted, and texts that share a variant and lie within CHECK_BITS bits in two other fingerprints are
candidates. Several fingerprints find what one misses; the exact check takes what doesn't belong.

Texts of one shingle set are one node. In a bucket candidates are linked to one pivot, not to each other: a
group of many copies gives a few links for each. The links are checked with the whole sets; what passes makes
components. Where a pivot's candidates are then in several components, those outside the pivot's own are
compared, in blocks, with all of them, so no candidate pair between different components goes unchecked.
Texts are read twice and never shuffled, only the sets of candidates are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelore.llm.common import HOT_SHARE, SMALL_ROWS, may_hold, membership, positional, split_join, trimmed
from pagelore.llm.components import components
from pagelore.llm.simhash import BITS, LINKS, TASK_ROWS, _block_links, _bucket_links, apart, segments_for
from pagelore.runtime import stored

WORDS, SIMILARITY = 5, 0.8
#: Fingerprints of a text, the radius that sets their segments (5: three of them), the bits of 128 that may differ: of
#: pairs of similarity 0.8, whose bits differ with a chance of 0.15, 98.7 % are within them.
PRINTS, RADIUS, CHECK_BITS = 4, 5, 28
BLOCK, STREAM = 256, 4096
#: Fixed odd mixing constants.
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Ascending distinct XXH64 (seed 42) of the word shingles: A-Z lower-cased, words split at
    [\\x20\\x09-\\x0D]; fewer words are one shingle, none give the empty set."""
    import xxhash

    w = (text or "").encode().lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    h64, join = xxhash.xxh64_intdigest, b" ".join
    if len(w) <= words:
        return np.array([h64(join(w), 42)], np.uint64)
    return np.unique(np.fromiter((h64(join(s), 42) for s in zip(*[w[i:] for i in range(words)], strict=False)), np.uint64, len(w) - words + 1))


def prints_of(h: np.ndarray, n: int = PRINTS) -> list[int]:
    """SimHash fingerprints of a set of hashes, each by its own mixing of them; 0 for the empty set."""
    out = []
    for k in range(n):
        x = (h ^ np.uint64((k + 1) * MIX[1] & (2**64 - 1))) * np.uint64(MIX[0])
        x = (x ^ (x >> np.uint64(29))) * np.uint64(MIX[1])
        x ^= x >> np.uint64(32)
        ones = np.zeros(BITS, np.int64)
        for at in range(0, len(x), 1 << 16):
            ones += np.unpackbits(x[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0]))
    return out


def _set_hash(h: np.ndarray) -> tuple[int, int]:
    import xxhash

    d = xxhash.xxh3_128_digest(h.astype("<u8").tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _signed(x) -> pa.Array:
    return pa.array(np.array(x, dtype=np.uint64).view(np.int64))


def _prints(words: int, n: int):
    def run(batches):
        for b in batches:
            sets = [shingles(t, words) for t in b.column(2).to_pylist()]
            keys, fps = [_set_hash(h) for h in sets], [prints_of(h, n) for h in sets]
            yield pa.record_batch([b.column(0), b.column(1), *[pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)], *[_signed([f[i] for f in fps]) for i in range(n)]], names=["id", "row", "t1", "t2", *[f"f{i}" for i in range(n)]])

    return run


def _sets(words: int):
    def run(batches):
        for b in batches:
            sets = [shingles(t, words) for t in b.column(0).to_pylist()]
            keys = [_set_hash(h) for h in sets]
            yield pa.record_batch([*[pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)], pa.array([h.astype("<u8").tobytes() for h in sets], pa.binary())], names=["t1", "t2", "shingles"])

    return run


def _variants(n: int, segments):
    """nodes (node, f0 ...) -> (key, fp, fq, node): fp, fq are the two fingerprints after the one that is indexed."""

    def run(batches):
        for b in batches:
            node, fps = b.column(0), [b.column(1 + k) for k in range(n)]
            for k in range(n):
                x, check = fps[k].to_numpy().view(np.uint64), (fps[(k + 1) % n], fps[(k + 2) % n])
                for s, (shift, width) in enumerate(segments):
                    seg = (x >> np.uint64(shift)) & np.uint64((1 << width) - 1)
                    for i in range(width):
                        key = (seg & np.uint64(~(1 << i) & (2**64 - 1))) | np.uint64(((k * len(segments) + s) * BITS + i) << 48)
                        yield pa.record_batch([pa.array(key.view(np.int64)), *check, node], names=["key", "fp", "fq", "node"])

    return run


def candidate_links(nodes: DataFrame, n: int = PRINTS, radius: int = RADIUS, bits: int = CHECK_BITS, bucket_cap: int = 4096) -> DataFrame:
    """nodes (node, f0 ...) -> distinct links (a, b), stored: in each bucket every candidate with its pivot."""
    segments = segments_for(radius)
    if max(w for _, w in segments) > 48 or n < 3:
        raise ValueError("three fingerprints or more of segments of 48 bits or less are needed")
    some = nodes.select("node", *[f"f{k}" for k in range(n)]).repartition(1 + nodes.count() * n * BITS // TASK_ROWS)
    rows = some.mapInArrow(_variants(n, segments), "key bigint, fp bigint, fq bigint, node bigint")
    found = stored(rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(trimmed(_bucket_links(bits, bucket_cap)), LINKS), "found")
    links, crowded = found.where("b is not null").select("a", "b"), found.where("b is null")
    if crowded.isEmpty():
        return stored(links.distinct(), "links", found.count())
    return stored(links.union(_block_links(crowded, bits, bucket_cap)).distinct(), "links")


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two ascending sets have at least this Jaccard similarity; two empty ones are equal."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both)


def _verify(least: float, bits: int | None):
    """Rows (grp, kind, node, label, fp, fq, shingles) sorted by grp and kind: of each group first its probes
    (kind 0), then what they are compared with -> links (a, b) of similar nodes with different labels."""

    def run(batches):
        at, probes = None, []
        for b in batches:
            out = []
            fp = np.stack([b.column(c).to_numpy().view(np.uint64) for c in (4, 5)], axis=1)
            own = None
            for i, (g, kind, node, label, raw) in enumerate(zip(*(b.column(c).to_pylist() for c in (0, 1, 2, 3, 6)), strict=True)):
                if g != at:
                    at, probes, own = g, [], None
                if kind == 0:
                    probes.append((node, label, fp[i], np.frombuffer(raw, "<u8")))
                    own = None
                    continue
                if own is None:
                    own = np.array([p[2] for p in probes], np.uint64).reshape(-1, 2)
                near = range(len(probes)) if bits is None else np.flatnonzero(apart(own, fp[i]) <= bits).tolist()
                h = None
                for k in near:
                    p = probes[k]
                    if p[0] != node and p[1] != label:
                        h = np.frombuffer(raw, "<u8") if h is None else h
                        if similar(p[3], h, least):
                            out.append((p[0], node))
            yield pa.record_batch([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def _verified(rows: DataFrame, sets: DataFrame, least: float, bits: int | None) -> DataFrame:
    """rows (grp, kind, node, label), sets (node, fp, fq, shingles) -> links (a, b)."""
    whole = rows.join(sets, "node").select("grp", "kind", "node", "label", "fp", "fq", "shingles")
    return whole.repartition("grp").sortWithinPartitions("grp", "kind").mapInArrow(trimmed(_verify(least, bits)), "a bigint, b bigint").distinct()


def _checked(links: DataFrame, sets: DataFrame, least: float, bits: int) -> DataFrame:
    """Candidate links (pivot a, b) -> (node, root) of the components of the links that pass."""
    total = links.count()
    sizes = stored(links.groupBy("a").agg(F.count("*").alias("n")), "pivots", total)
    # A pivot with many candidates is dealt to several groups, itself in each.
    parts = F.ceil(F.col("n") / STREAM).cast("bigint")
    probe = sizes.select(F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("part"), "a").select(F.xxhash64("a", "part").alias("grp"), F.lit(0).alias("kind"), F.col("a").alias("node"), F.col("a").alias("label"))
    stream = split_join(links, sizes, ["a"], "n", total, small=SMALL_ROWS).select(F.xxhash64("a", F.pmod(F.xxhash64("b"), parts)).alias("grp"), F.lit(1).alias("kind"), F.col("b").alias("node"), F.col("b").alias("label"))
    # Groups whose hashes meet are compared with each other too: more comparisons, no wrong link.
    first = stored(_verified(probe.unionByName(stream), sets, least, None), "similar", 2 * total)

    label = stored(components(first, at_most=2 * total), "labels", 4 * total)
    star = links.unionByName(sizes.select("a", F.col("a").alias("b"))).withColumnRenamed("b", "node")
    star = star.join(label, "node", "left").select("a", "node", F.coalesce("root", "node").alias("label"))
    own = star.where("a = node").select("a", F.col("label").alias("own"))
    star = stored(split_join(star, own.join(sizes.select("a", (F.col("n") + 1).alias("n")), "a"), ["a"], "n", 2 * total, small=SMALL_ROWS).drop("n"), "stars", 2 * total)
    # Of a pivot whose star is in several components: the members outside its own are the probes, in blocks.
    rest = star.where("label <> own").groupBy("a").agg(F.count("*").alias("strangers"))
    rest = stored(rest.join(sizes, "a").where("n > 1").select("a", "n", F.ceil(F.col("strangers") / BLOCK).cast("bigint").alias("blocks"), F.ceil((F.col("n") + 1) / STREAM).cast("bigint").alias("parts")), "rest", total)
    if rest.isEmpty():
        return label
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    member = split_join(star, rest.withColumn("n", F.col("n") + 1), ["a"], "n", 2 * total, small=SMALL_ROWS)
    group = F.xxhash64("a", "block", "part", F.lit("rest")).alias("grp")
    probe = member.where("label <> own").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("part", every("parts")).select(group, F.lit(0).alias("kind"), "node", "label")
    stream = member.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))).withColumn("block", every("blocks")).select(group, F.lit(1).alias("kind"), "node", "label")
    return components(first.unionByName(stored(_verified(probe.unionByName(stream), sets, least, bits), "similar")))


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: float = SIMILARITY, prints: int = PRINTS, radius: int = RADIUS, bits: int = CHECK_BITS, bucket_cap: int = 4096) -> DataFrame:
    """(id, row, component) of each row, row being xxhash64(id, text) and component the smallest id that
    checked links reach, its own included; null if all ids of the component are null.

    Null, empty and blank texts have the empty set of shingles and are equal. Rows of one id with different
    texts are judged one by one; repeated rows give repeated rows. Ids are whole numbers: others fail. An
    empty table gives an empty result.
    """
    i, t = (F.col(f"_c{docs.columns.index(c)}") for c in (id_col, text_col))
    rows = positional(docs).select(i.cast("bigint").alias("id"), F.xxhash64(i, t).alias("row"), t.alias("text"))
    seen = stored(rows.mapInArrow(trimmed(_prints(words, prints)), "id bigint, row bigint, t1 bigint, t2 bigint, " + ", ".join(f"f{k} bigint" for k in range(prints))), "prints")
    groups = seen.groupBy("t1", "t2").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.min("row").alias("row"), *[F.min(f"f{k}").alias(f"f{k}") for k in range(prints)])
    rows_in = seen.count()
    nodes = stored(groups.withColumn("node", F.monotonically_increasing_id()), "nodes", rows_in)
    links = candidate_links(nodes, prints, radius, bits, bucket_cap)
    n = links.count()

    named = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().join(nodes.select("node", "row", "t1", "t2", F.col("f0").alias("fp"), F.col("f1").alias("fq")), "node")
    named = stored(named, "named", 2 * n)
    read = may_hold(rows, membership(named.select(F.col("row").alias("_h"))), F.col("row")).where("_may").select("text").mapInArrow(trimmed(_sets(words)), "t1 bigint, t2 bigint, shingles binary")
    sets = stored(read.join(named.select("node", "fp", "fq", "t1", "t2"), ["t1", "t2"]).groupBy("node").agg(F.min("fp").alias("fp"), F.min("fq").alias("fq"), F.first("shingles").alias("shingles")), "sets")

    roots = stored(_checked(links, sets, least, bits), "roots", 4 * n)
    node = nodes.select("node", "t1", "t2", "n", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least_of = node.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("nodes"))
    alone = node.select("t1", "t2", "n", "root")
    classes = split_join(alone, least_of, ["root"], "nodes", nodes.count(), small=SMALL_ROWS).select("t1", "t2", "n", "component")
    return split_join(seen.select("id", "row", "t1", "t2"), stored(classes, "classes", rows_in), ["t1", "t2"], "n", rows_in).select("id", "row", "component")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rule) -> DataFrame:
    """docs without near duplicates: of each class the row with the smallest id stays, with all its columns
    as they are; rows that repeat id and text are one document. Rows of the null id stay if no other id is
    in their class. Rows that no membership filter of bounded size takes for one that goes stay where they are;
    the others are compared, with id and hash, with those that go."""
    classes = similar_documents(docs, id_col, text_col, **rule)
    gone = stored(classes.where(F.col("component").isNotNull() & ~F.col("id").eqNullSafe(F.col("component"))).groupBy("id", "row").agg(F.count("*").alias("n")), "gone")
    total = gone.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    i, t = (F.col(f"_c{docs.columns.index(c)}") for c in (id_col, text_col))
    flagged = may_hold(positional(docs).withColumn("_row", F.xxhash64(i, t)), membership(gone.select(F.col("row").alias("_h"))), F.col("_row"))
    rest, same = flagged.where("_may"), i.cast("bigint").eqNullSafe(F.col("id")) & (F.col("_row") == F.col("row"))
    hot, cold = gone.where(F.col("n") > total / HOT_SHARE), gone.where(F.col("n") <= total / HOT_SHARE)
    rest = rest.join(F.broadcast(hot), same, "left_anti").join(cold, same, "left_anti")
    return flagged.where(~F.col("_may")).unionByName(rest).drop("_may", "_row").toDF(*docs.columns)
