"""Nearest neighbours by vantage-point trees, one per shard, with relaxable pruning.

Vectors are dealt to shards of about SHARD_ROWS by a hash of their contents. A task reads one shard after
the other, sorted so that the vectors come first and the queries behind them: it builds the shard's tree,
streams the queries through it in blocks, emits each query's best of the shard, and forgets it. Memory is
bounded by a shard and a block; no query set is broadcast. Vectors are unit length in the tree, where
Euclidean distance orders as cosine does. A subtree is skipped when relax x (its least possible distance)
exceeds the distance of the worst neighbour held: 1 is exact, above 1 skips more.

Of equal vectors only the k + 1 smallest ids can ever be among k nearest, ties going to the smaller id and
the query's own id left out; the others are dropped before the shuffle, by a map-side limit, so a vector
that a third of all rows share stays a few rows. The best of all shards are merged by a window over
k rows of each shard. Different vectors can have one cosine (v, 2 v, 4 v): where more rows than the tree
holds lie within a rounding margin of the (k + 1)-th best, the shard is scanned for all of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelore.runtime import stored, table

SHARD_ROWS, LEAF, BLOCK, SLACK = 16_384, 256, 1024, 4
#: Cosines of the tree that differ by less may be in another order, or equal, when rescored.
MARGIN = 1e-11
FOUND = "query_id bigint, vec_id bigint, score double"


class VpTree:
    def __init__(self, unit: np.ndarray, leaf: int = LEAF, seed: int = 3):
        self.unit, self.nodes = unit, []
        rng = np.random.default_rng(seed)
        self.visited = 0
        root = [0, np.arange(len(unit))]
        todo = [root]
        while todo:  # a node: (rows) or (vantage point, greatest inner and least outer distance, inner, outer)
            slot, rows = todo.pop()
            while len(self.nodes) <= slot:
                self.nodes.append(None)
            if len(rows) <= leaf:
                self.nodes[slot] = (rows,)
                continue
            vp = rows[rng.integers(len(rows))]
            d = self.distance(unit[rows], unit[vp])
            order = np.argsort(d, kind="stable")
            half = len(rows) // 2
            inner, outer = rows[order[:half]], rows[order[half:]]
            a = len(self.nodes)
            self.nodes += [None, None]
            self.nodes[slot] = (unit[vp], d[order[half - 1]], d[order[half]], a, a + 1)
            todo += [[a, inner], [a + 1, outer]]

    @staticmethod
    def distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 2 - 2 * (x @ y)))

    def search(self, queries: np.ndarray, keep: int, need: int, relax: float) -> tuple[np.ndarray, np.ndarray]:
        """(rows, cosines) of the ``keep`` best of each query; the ``need``-th bounds the search. -1: none."""
        self.best = np.full((len(queries), keep), -2.0)
        self.rows = np.full((len(queries), keep), -1)
        self.queries, self.keep, self.need, self.relax = queries, keep, need, relax
        if len(self.unit) and len(queries):
            self._visit(0, np.arange(len(queries)))
        return self.rows, self.best

    def _bound(self, act):
        # Near 0 a distance is the root of a rounding error: ties lie up to about 1e-6 apart.
        return np.sqrt(np.maximum(0.0, 2 - 2 * self.best[act, self.need - 1])) + 1e-5

    def _visit(self, slot: int, act: np.ndarray) -> None:
        if not len(act):
            return
        node = self.nodes[slot]
        if len(node) == 1:
            rows = node[0]
            self.visited += len(act) * len(rows)
            cos = self.queries[act] @ self.unit[rows].T
            better = np.flatnonzero(cos.max(axis=1) > self.best[act, -1])
            act, cos = act[better], np.concatenate([self.best[act[better]], cos[better]], axis=1)
            ids = np.concatenate([self.rows[act], np.broadcast_to(rows, (len(act), len(rows)))], axis=1)
            top = np.argsort(-cos, axis=1, kind="stable")[:, : self.keep]
            self.best[act], self.rows[act] = np.take_along_axis(cos, top, 1), np.take_along_axis(ids, top, 1)
            return
        vp, inner_to, outer_from, inner, outer = node
        d = self.distance(self.queries[act], vp)
        near = d <= (inner_to + outer_from) / 2
        ins, outs = act[near], act[~near]
        self._visit(inner, ins)
        self._visit(outer, outs)
        self._visit(outer, ins[self.relax * (outer_from - d[near]) <= self._bound(ins)])
        self._visit(inner, outs[self.relax * (d[~near] - inner_to) <= self._bound(outs)])


def _sum(x: np.ndarray) -> np.ndarray:
    """Sums along the last axis, added from left to right: the same bits wherever a row stands."""
    return np.cumsum(x, axis=-1)[..., -1]


def _search_shard(k: int, relax: float):
    def run(batches):
        shard, ids, vecs, tree, uniq = None, [], [], None, None

        def build():
            x = np.concatenate(vecs)
            own = np.concatenate(ids)
            # Rows come sorted by id; equal vectors share a node, their ids in ascending order.
            _, first, inverse = np.unique(x, axis=0, return_index=True, return_inverse=True)
            order = np.argsort(inverse, kind="stable")
            ends = np.searchsorted(inverse[order], np.arange(1, len(first)))
            rows = x[first].astype(np.float64)
            norm = np.sqrt(_sum(rows * rows))
            return (rows, norm, np.split(own[order], ends)), VpTree(rows / norm[:, None])

        def answer(qid, q):
            (rows, norm, members), out = uniq, ([], [], [])
            for at in range(0, len(qid), BLOCK):
                x = q[at : at + BLOCK].astype(np.float64)
                own = np.sqrt(_sum(x * x))
                found, best = tree.search(x / own[:, None], k + 1 + SLACK, k + 1, relax)
                tied = (found[:, -1] >= 0) & (best[:, -1] >= best[:, k] - MARGIN)
                for i, r in enumerate(found):
                    if tied[i]:  # more rows than are held may be among the best: all of the shard that may
                        r = np.flatnonzero(tree.unit @ (x[i] / own[i]) >= best[i, k] - MARGIN)
                    r = r[r >= 0]
                    score = _sum(rows[r] * x[i]) / (own[i] * norm[r])
                    if tied[i]:  # each row has an id, so k + 1 of them have k besides the query's own
                        top = np.lexsort(([members[j][0] for j in r.tolist()], -score))[: k + 1]
                        r, score = r[top], score[top]
                    me = qid[at + i]
                    got = sorted((-s, v) for s, j in zip(score.tolist(), r.tolist(), strict=True) for v in members[j][: k + 1].tolist() if v != me)[:k]
                    out[0].extend([me] * len(got))
                    out[1].extend(v for _, v in got)
                    out[2].extend(-s for s, _ in got)
            return pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])

        for b in batches:
            key, kind, vid = (b.column(c).to_numpy() for c in (0, 1, 2))
            dim = len(b.column(3)[0]) if b.num_rows else 0
            ends = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (kind[1:] != kind[:-1])]) if b.num_rows else []
            for s, e in zip(ends, [*ends[1:], b.num_rows], strict=True):
                if key[s] != shard:
                    shard, ids, vecs, tree = key[s], [], [], None
                dim = len(b.column(3)[int(s)])
                x = b.column(3).slice(int(s), int(e - s)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                if kind[s] == 0:
                    ids.append(vid[s:e])
                    vecs.append(x)
                elif ids:
                    if tree is None:
                        uniq, tree = build()
                    yield answer(vid[s:e], x)

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, relax: float = 1.0, id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of ``vectors`` of largest cosine for each row of
    ``queries`` (all, if fewer), the query's own id left out; ties go to the smaller id. Both tables
    hold id_col and vec_col. Rows whose id or vector is null, whose vector is empty or zero or has a null
    or non-finite component take no part. Only vectors of one length are compared. Rows that repeat an
    id are one candidate, by its best score. Ids are whole numbers: others fail. Only the two columns are read,
    whatever the names of the others. A table without usable rows gives an empty result.
    """
    v = F.col(vec_col)
    usable = F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    tidy = lambda df: df.where(F.coalesce(usable, F.lit(False))).select(F.col(id_col).cast("bigint").alias("id"), v.cast("array<float>").alias("v") if dict(df.dtypes)[vec_col] == "array<float>" else v.cast("array<double>").alias("v")).distinct()
    rows = tidy(vectors)
    by_vec = Window.partitionBy("v").orderBy("id")
    rows = stored(rows.withColumn("r", F.row_number().over(by_vec)).where(F.col("r") <= k + 1).drop("r"), "vectors")
    shards = max(1, -(-rows.count() // shard_rows))
    key = lambda n: F.size("v").cast("bigint") * (1 << 32) + n
    deal = rows.select(key(F.pmod(F.xxhash64("v"), F.lit(shards))).alias("shard"), F.lit(0).alias("kind"), "id", "v")
    ask = tidy(queries).select("id", "v", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))).alias("n")).select(key(F.col("n")).alias("shard"), F.lit(1).alias("kind"), "id", "v")
    order = ["shard", "kind", "id"]
    found = deal.unionByName(ask).repartition("shard").sortWithinPartitions(*order).mapInArrow(_search_shard(k, relax), FOUND)
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_nearest_neighbours(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5, relax=1.0)


SQL = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, e, sqrt(list_reduce(list_transform(e, lambda x: x * x), lambda a, b: a + b)) AS norm FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]), lambda a, b: a + b) / (q.norm * c.norm) AS score
      FROM n q JOIN n c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
