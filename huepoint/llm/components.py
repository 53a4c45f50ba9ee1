"""Connected components of a link table, by alternating large-star and small-star rounds.

Every round is a minimum by key and a join, written to the shared folder; the hub of a large component
isn't joined in one task (``keyed_join``). Nothing comes to the driver but the count and checksum that
tell whether a round changed anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huepoint.llm._store import keyed_join, stash

MOST_ROUNDS = 60


def _stars(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """edges: hi > lo. Large star links larger neighbours to a node's minimum, small star the smaller ones and itself."""
    if large:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("rows"))
        out = keyed_join(both.filter("v > u"), least, ["u"], "rows", 2 * total).select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    else:
        least = edges.groupBy("hi").agg(F.min("lo").alias("m"), F.count(F.lit(1)).alias("rows"))
        out = keyed_join(edges, least, ["hi"], "rows", total).select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("x")).select("x.*")
    return out.filter("hi > lo").distinct()


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` of distinct longs -> (id, component): the smallest id reachable, for every id in a link."""
    edges = stash(links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi > lo").distinct())
    state = None
    for _ in range(MOST_ROUNDS):
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h")).first()
        if (now["n"], now["h"]) == state or not now["n"]:
            lows = edges.select("lo").distinct()
            return edges.select(F.col("hi").alias("id"), F.col("lo").alias("component")).unionByName(lows.select(F.col("lo").alias("id"), F.col("lo").alias("component")))
        state = (now["n"], now["h"])
        edges = stash(_stars(stash(_stars(edges, True, now["n"])), False, now["n"]))
    raise RuntimeError(f"no fixed point after {MOST_ROUNDS} rounds")
