"""Connected components of a table of links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


ONE_TASK = 100_000      # links that one task can hold at ease


def united(batches):
    """Kernel: (node, component) of a few links (a, b), by hooking roots to smaller neighbours until none is left."""
    import pyarrow as pa

    links = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
    if not links:
        return
    ends = np.concatenate([x[0] for x in links] + [x[1] for x in links])
    nodes, at = np.unique(ends, return_inverse=True)
    a, b = at[: len(at) // 2], at[len(at) // 2:]
    root = np.arange(len(nodes))
    while (root[a] != root[b]).any():
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != root[root]).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "component"])


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b): component is the smallest node reachable.

    Each round every node follows the neighbour (or itself) whose hash is least, links are moved to where their
    ends went, and what remains is again a table of links, a constant fraction smaller. Minima are taken
    map-side, so a node with many links is no large group. Nothing returns to the driver but how many links remain;
    once there are ONE_TASK at most, one task unites them without further rounds.
    """
    links = stored(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    turns = []
    while links.count() > ONE_TASK:
        both = links.select("a", "b").union(links.select("b", "a")).toDF("node", "other")
        salt = F.lit(len(turns))
        least = F.min(F.struct(F.xxhash64("other", salt).alias("h"), F.col("other").alias("to")))
        own = F.struct(F.xxhash64("node", salt).alias("h"), F.col("node").alias("to"))
        moves = stored(both.groupBy("node").agg(least.alias("m")).select("node", F.least(own, "m")["to"].alias("to")))
        turns.append(moves)
        moved = links.join(moves.toDF("a", "ta"), "a").join(moves.toDF("b", "tb"), "b").filter("ta <> tb")
        links = stored(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
    last = stored(links.coalesce(1).mapInArrow(united, "node long, component long"))
    if not turns:
        return last
    placed = turns[0].toDF("node", "at")
    for moves in [*turns[1:], last]:
        placed = placed.join(moves.toDF("at", "to"), "at", "left").select("node", F.coalesce("to", "at").alias("at"))
    placed = stored(placed)
    names = placed.groupBy("at").agg(F.min("node").alias("component"))
    return placed.join(names, "at").select("node", "component")
