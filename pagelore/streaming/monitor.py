"""Extension: an online hit-ratio monitor. A stream of page requests goes through one cache per group key, whose
state survives from batch to batch; hits are summed up in event-time windows with a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelore.operators.cache import Lru

OUT = "group string, ts timestamp, page_id bigint, hit boolean"


def with_hits(requests: DataFrame, capacity: int) -> DataFrame:
    """requests (group, ts, page_id) + hit, through an LRU cache of each group, in order of ts inside a batch."""

    def step(key, frames: Iterator[pd.DataFrame], state):
        lru = Lru(capacity)
        if state.exists:
            for page in state.get[0]:
                lru.put(page)
        rows = pd.concat(list(frames)).sort_values(["ts", "page_id"], kind="stable")
        hits = []
        for page in rows["page_id"]:
            hits.append(lru.get(page))
            lru.put(page)
        state.update((list(map(int, lru.pages)),))
        yield rows.assign(hit=hits)[["group", "ts", "page_id", "hit"]]

    return requests.groupBy("group").applyInPandasWithState(step, OUT, "pages array<bigint>", "append", "NoTimeout")


def hit_ratio_windows(flagged: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """(window, group, requests, hits) by event time; rows later than the watermark are left out."""
    return flagged.withWatermark("ts", late).groupBy(F.window("ts", window), "group").agg(F.count("*").alias("requests"), F.sum(F.col("hit").cast("bigint")).alias("hits"))
