"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step is a group-by with partial minima and a join; nothing is gathered per component, so a component may hold any
share of all nodes. Every round is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import discarded, written

#: Rounds are logarithmic in the longest chain; this many would do for any real table.
MAX_ROUNDS = 60


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """u, v (u > v): every node's neighbours are linked to the least among them and the node itself."""
    both = links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        found = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        found = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return found.filter("u > v").distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first())


def components(links: DataFrame) -> DataFrame:
    """node, root (long): for every node of links (u, v: long) the least node that it is connected with.

    Direction, repeats and links of a node to itself don't matter; rows with a null are left out; no links, no rows.
    """
    nodes = links.dropna(subset=["u", "v"])
    now = written(nodes.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = _state(now)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        ahead = written(_stars(_stars(now, True), False), "links")
        discarded(now)
        now, before, state = ahead, state, _state(ahead)
        if state == before:
            break
    else:
        raise RuntimeError(f"components are not complete after {MAX_ROUNDS} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    alone = nodes.filter("u = v").select(F.col("u").alias("node")).distinct()
    found = now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
    return found.unionAll(alone.join(found, "node", "left_anti").select("node", F.col("node").alias("root")))
