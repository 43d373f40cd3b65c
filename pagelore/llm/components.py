"""Connected components of a link table, by alternating large-star and small-star steps.

Each round is two joins and aggregations over links alone; rounds are logarithmic in the length of the
longest chain. No link is ever collected. A node's links are pre-aggregated to their minimum before any
join, and each round's links are made distinct, so a star of many leaves stays as many rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelore.llm.common import SMALL_ROWS, split_join
from pagelore.runtime import stored


def _star(links: DataFrame, large: bool, total: int) -> DataFrame:
    """links (a, b) -> each neighbour of a node linked to the least of the node and its neighbours;
    large: the neighbours greater than the node, small: those smaller, and the node itself. total: a bound
    of twice their number; the few nodes with a great share of the links are joined by broadcast."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if large:
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", "n", F.least("a", "m").alias("m"))
        out = split_join(both.where("b > a"), low, ["a"], "n", total, small=SMALL_ROWS).select(F.col("b").alias("x"), F.col("m").alias("y"))
    else:
        down = both.where("b < a")
        low = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        out = split_join(down, low, ["a"], "n", total, small=SMALL_ROWS).select(F.col("b").alias("x"), F.col("m").alias("y")).union(low.select(F.col("a").alias("x"), F.col("m").alias("y")))
    return out.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def components(links: DataFrame, max_rounds: int = 50, at_most: int | None = None) -> DataFrame:
    """links (a, b) of one orderable type -> (node, root) of every node with a link, root the least node reachable.
    at_most: a known bound of the number of links, if there is one."""
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = stored(links, "links", at_most)
    state = None
    for _ in range(max_rounds):
        now = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now.n == 0 or (now.n, now.h) == state:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        state = (now.n, now.h)
        # A step makes at most two links of one.
        links = stored(_star(_star(links, True, 2 * now.n), False, 2 * now.n), "links", 4 * now.n)
    raise RuntimeError("links did not settle")
