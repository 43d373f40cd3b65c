"""Exact replay of page traces through FIFO, LRU and LFU caches.

A replay is sequential, so it is parallel over configurations, not inside a trace: the trace is dealt once to
each configuration, one partition for each, sorted by (query_idx, seq), and streamed through one cache whose memory is its capacity.
put_mode ``immediate`` stores a page right after its miss; ``deferred`` asks for a query's whole window first
and stores a run of misses when a hit or the end of the window follows it.
"""

from __future__ import annotations

from collections import OrderedDict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelore.schema import PAGE_BYTES, POLICIES, STRATEGIES


class Null:
    def __init__(self, capacity: int = 0):
        self.capacity = 0

    def get(self, page) -> bool:
        return False

    def put(self, page) -> None:
        pass

    def run(self, first: int, n: int) -> int:
        return 0


class Fifo:
    """Evicts what came first; neither hits nor repeated puts change the order."""

    def __init__(self, capacity: int):
        self.capacity, self.pages = capacity, OrderedDict()

    def get(self, page) -> bool:
        return page in self.pages

    def put(self, page) -> None:
        if not self.capacity or page in self.pages:
            return
        if len(self.pages) >= self.capacity:
            self.pages.popitem(last=False)
        self.pages[page] = None

    def run(self, first: int, n: int) -> int:
        """Hits of n pages from first on, each stored right after its miss. At most capacity pages of a run can hit,
        so behind twice as many all that was there before is gone: the rest misses, and its last pages stay."""
        end, hits = first + n, 0
        for page in range(first, min(end, first + 2 * self.capacity)):
            if self.get(page):
                hits += 1
            else:
                self.put(page)
        for page in range(max(first + 2 * self.capacity, end - self.capacity), end):
            self.put(page)
        return hits


class Lru(Fifo):
    """Evicts what was used longest ago."""

    def get(self, page) -> bool:
        if page in self.pages:
            self.pages.move_to_end(page)
            return True
        return False

    def put(self, page) -> None:
        if not self.get(page):
            super().put(page)


class Lfu:
    """Evicts the least used of those inside, of equals the one used longest ago; what was evicted starts anew."""

    def __init__(self, capacity: int):
        self.capacity, self.uses, self.by_uses = capacity, {}, {}

    def get(self, page) -> bool:
        n = self.uses.get(page)
        if n is None:
            return False
        peers = self.by_uses[n]
        del peers[page]
        if not peers:
            del self.by_uses[n]
        self.uses[page] = n + 1
        self.by_uses.setdefault(n + 1, OrderedDict())[page] = None
        return True

    def put(self, page) -> None:
        if not self.capacity or self.get(page):
            return
        if len(self.uses) >= self.capacity:
            least = min(self.by_uses)
            gone, _ = self.by_uses[least].popitem(last=False)
            if not self.by_uses[least]:
                del self.by_uses[least]
            del self.uses[gone]
        self.uses[page] = 1
        self.by_uses.setdefault(1, OrderedDict())[page] = None

    def run(self, first: int, n: int) -> int:
        """Hits of n pages from first on, each stored right after its miss. Once the cache is full and only pages of
        this run have one use, its misses evict nothing else: pages used more often hit wherever they lie, and
        between them the pages of one use are the last that missed."""
        end, page, hits = first + n, first, 0
        if not self.capacity:
            return 0
        while page < end:
            once = self.by_uses.get(1)
            if once and first <= next(iter(once)) < page and len(self.uses) >= self.capacity:
                break
            if self.get(page):
                hits += 1
            else:
                self.put(page)
            page += 1
        if page == end:
            return hits
        for stop in [*sorted(p for p in self.uses if page <= p < end), end]:
            for p in range(max(page, stop - len(once)), stop):
                gone, _ = once.popitem(last=False)
                del self.uses[gone]
                once[p], self.uses[p] = None, 1
            if stop < end:
                self.get(stop)
                hits += 1
            page = stop + 1
        return hits


CACHES = {"NONE": Null, "FIFO": Fifo, "LRU": Lru, "LFU": Lfu}


def capacity_pages(cache_bytes: int, page_bytes: int = PAGE_BYTES) -> int:
    return max(0, cache_bytes) // page_bytes


def parse_list(text: str, known: tuple[str, ...], upper: bool) -> list[str]:
    """Comma list, ALL for everything, each once in the order given."""
    names = [x.strip().upper() if upper else x.strip().lower() for x in text.split(",") if x.strip()]
    if any(x.upper() == "ALL" for x in names):
        return list(known)
    if bad := [x for x in names if x not in known]:
        raise ValueError(f"unknown: {', '.join(bad)}")
    return list(dict.fromkeys(names))


def parse_policies(text: str) -> list[str]:
    return parse_list(text, POLICIES, True)


def parse_strategies(text: str) -> list[str]:
    return parse_list(text, STRATEGIES, False)


def index_bytes(n: int, eps: int) -> int:
    return 16 * n // (2 * eps)


def cache_bytes(budget_mode: str, memory: int, n: int = 0, eps: int = 1, measured: int = 0, fixed: int = 0) -> int:
    """Bytes left for the cache: RAW all, ESTIMATED less the closed form, MEASURED less the index, FIXED as given."""
    left = {"RAW": memory, "ESTIMATED": memory - index_bytes(n, eps), "MEASURED": memory - measured, "FIXED_CACHE": fixed}
    return max(0, left[budget_mode.upper()])


def warm_pages(pages: int, capacity: int, seed: int = 42) -> list[int]:
    """Distinct pages to fill a cache with before a replay: those of least hash, a function of the seed."""
    import hashlib
    import heapq

    return heapq.nsmallest(min(pages, capacity), range(pages), key=lambda p: (hashlib.md5(f"{seed}|warm|{p}".encode()).hexdigest()[:13], p))


def replay(trace: DataFrame, configs: list[dict], warm: list[int] | None = None) -> DataFrame:
    """trace (query_idx, seq, page_id) through each of configs (policy, capacity, put_mode='immediate') ->
    (config, policy, capacity, query_idx, seq, page_id, hit). warm: pages stored before the first request."""
    cfg = [(c["policy"].upper(), int(c["capacity"]), c.get("put_mode", "immediate")) for c in configs]
    if any(p not in CACHES or m not in ("immediate", "deferred") for p, _, m in cfg):
        raise ValueError("unknown policy or put mode")
    warm = list(warm or [])

    def run(batches):
        at, cache, mode, query, missed = None, None, None, None, []
        for b in batches:
            hits = []
            for c, q, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                if c != at:
                    policy, capacity, mode = cfg[c]
                    at, cache, query, missed = c, CACHES[policy](capacity), None, []
                    for p in warm:
                        cache.put(p)
                if missed and q != query:
                    for p in missed:
                        cache.put(p)
                    missed = []
                query = q
                hit = cache.get(page)
                hits.append(hit)
                if hit:
                    for p in missed:
                        cache.put(p)
                    missed = []
                elif mode == "immediate":
                    cache.put(page)
                else:
                    missed.append(page)
            yield pa.record_batch([*b.columns, pa.array(hits, pa.bool_())], names=["config", "query_idx", "seq", "page_id", "hit"])

    dealt = trace.select(F.explode(F.array(*[F.lit(i) for i in range(len(cfg))])).alias("config"), F.col("query_idx").cast("bigint").alias("query_idx"), F.col("seq").cast("int").alias("seq"), F.col("page_id").cast("bigint").alias("page_id"))
    out = dealt.repartitionById(len(cfg), F.col("config")).sortWithinPartitions("config", "query_idx", "seq").mapInArrow(run, "config int, query_idx bigint, seq int, page_id bigint, hit boolean")
    named = lambda k: F.element_at(F.array(*[F.lit(c[k]) for c in cfg]), F.col("config") + 1)
    return out.select("config", named(0).alias("policy"), named(1).alias("capacity"), "query_idx", "seq", "page_id", "hit")


def replay_totals(looked: DataFrame, configs: list[dict]) -> DataFrame:
    """replay_summary of the replay of page windows (query_idx, page_lo, dac), one for each query, without a row for
    each request: sorted windows go to the configurations in compressed blocks, and each gives its totals."""
    cfg = [(c["policy"].upper(), int(c["capacity"]), c.get("put_mode", "immediate")) for c in configs]
    if any(p not in CACHES or m not in ("immediate", "deferred") for p, _, m in cfg):
        raise ValueError("unknown policy or put mode")

    def pack(batches):
        last, k = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            q = b.column(1).to_pylist()
            new = [x is not None and x != y for x, y in zip(q, [last, *q[:-1]], strict=True)]
            last = q[-1]
            block = pa.record_batch([pa.array(new, pa.bool_()), b.column(2), b.column(3)], names=["new", "page_lo", "dac"])
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, block.schema, options=pa.ipc.IpcWriteOptions(compression="zstd" if pa.Codec.is_available("zstd") else None)) as w:
                w.write_batch(block)
            yield pa.record_batch([b.column(0)[:1], pa.array([k], pa.int32()), pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["part", "k", "block"])
            k += 1

    def run(batches):
        at, done = None, None
        for b in batches:
            for c, block in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True):
                if c != at:
                    if done:
                        yield totals(at, done)
                    policy, capacity, mode = cfg[c]
                    at, cache, done = c, CACHES[policy](capacity), [0, 0, 0]
                t = pa.ipc.open_stream(block).read_all()
                los, ns = t.column("page_lo").to_pylist(), t.column("dac").to_pylist()
                done[0] += t.column("new").to_pylist().count(True)
                done[1] += sum(ns)
                done[2] += sum(map(cache.run, los, ns)) if mode == "immediate" else sum(deferred(cache, lo, n) for lo, n in zip(los, ns, strict=True))
        if done:
            yield totals(at, done)

    def deferred(cache, lo, n):
        hits, missed = 0, []
        for page in range(lo, lo + n):
            if cache.get(page):
                hits += 1
                for p in missed:
                    cache.put(p)
                missed = []
            else:
                missed.append(page)
        for p in missed:
            cache.put(p)
        return hits

    def totals(at, done):
        return pa.record_batch([pa.array([at], pa.int32()), *[pa.array([x], pa.int64()) for x in done]], names=["config", "queries", "total_dac", "total_hits"])

    w = looked.select(*[F.col(c).cast("bigint").alias(c) for c in ("query_idx", "page_lo", "dac")])
    w = w.repartitionByRange("query_idx").sortWithinPartitions("query_idx", "page_lo", "dac").select(F.spark_partition_id().alias("part"), "query_idx", "page_lo", "dac")
    blocks = w.mapInArrow(pack, "part int, k int, block binary")
    dealt = blocks.select(F.explode(F.array(*[F.lit(i) for i in range(len(cfg))])).alias("config"), "part", "k", "block")
    out = dealt.repartitionById(len(cfg), F.col("config")).sortWithinPartitions("config", "part", "k").mapInArrow(run, "config int, queries bigint, total_dac bigint, total_hits bigint")
    named = lambda k: F.element_at(F.array(*[F.lit(c[k]) for c in cfg]), F.col("config") + 1)
    g = out.groupBy(named(0).alias("policy"), named(1).alias("capacity")).agg(F.max("queries").alias("queries"), F.sum("total_dac").alias("total_dac"), F.sum("total_hits").alias("total_hits"))
    return _rates(g)


def replay_summary(flagged: DataFrame) -> DataFrame:
    """Totals of each configuration: queries, requests, hits, misses, hit ratio, mean dac and mean misses."""
    g = flagged.groupBy("policy", "capacity").agg(F.count_distinct("query_idx").alias("queries"), F.count("*").alias("total_dac"), F.sum(F.col("hit").cast("bigint")).alias("total_hits"))
    return _rates(g)


def _rates(g: DataFrame) -> DataFrame:
    g = g.withColumn("total_misses", F.col("total_dac") - F.col("total_hits"))
    return g.withColumns({"hit_ratio": F.col("total_hits") / F.col("total_dac"), "avg_dac": F.col("total_dac") / F.col("queries"), "avg_misses": F.col("total_misses") / F.col("queries")})


def popularity(trace: DataFrame) -> DataFrame:
    """(page_id, refs)."""
    return trace.groupBy("page_id").agg(F.count("*").alias("refs"))
