"""Connected components of a graph given as a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import remove_written, written

MOST_ROUNDS = 60


def star(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links -> a star around the least node of each of their components: the same connections in fewer links."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[label[moved]], nodes[moved]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a partition -> stars, for each batch."""
    for batch in batches:
        least, node = star(*(np.asarray(c, dtype=np.int64) for c in (batch.column(0), batch.column(1))))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(least)], names=["u", "v"])


def connected_components(links: DataFrame) -> DataFrame:
    """links (u, v) of longs -> node, component (the least node reachable), for each node that has a link to another.

    Each step is two aggregations with a join; rounds are written to the shared folder. Hubs are pre-aggregated map-side,
    and partitions of a hub's links are split by adaptive execution, for the join only looks up one minimum.
    """
    edges = links.where("u <> v").select("u", "v").mapInArrow(_forest, "u long, v long").where("u <> v").distinct()
    edges = written(edges, "links")
    state = None
    for _ in range(MOST_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = written(small, "links")
        remove_written(edges)
        edges = new
        now = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v") % 1000003)).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components didn't settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
