"""Connected components of a link table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


#: Links that one task reduces to stars at a time; the number of partitions follows from it.
TASK_LINKS = 200_000


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from every node to the smallest node that these links reach."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while (root[x] != root[y]).any():
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while (root != root[root]).any():
            root = root[root]
    away = root != np.arange(len(nodes))
    return nodes[away], nodes[root[away]]


def _local_stars(links: DataFrame) -> DataFrame:
    """The same components with fewer links: each TASK_LINKS links of a partition become stars. Partitions get as many links, or fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            a, b = (np.concatenate((v, batch.column(k).to_numpy())) for k, v in enumerate((a, b)))
            if len(a) >= TASK_LINKS:
                a, b = _forest(a, b)
                if 2 * len(a) >= TASK_LINKS:
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
                    a, b = a[:0], b[:0]
        a, b = _forest(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return links.coalesce(links.count() // TASK_LINKS + 1).mapInArrow(run, "a long, b long")


def _nearest(links: DataFrame) -> DataFrame:
    return links.groupBy("a").agg(F.min("b").alias("low"))


def _stars(links: DataFrame) -> bool:
    """Whether each larger end has one link and is no smaller end: then the smaller ends are the components."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        links.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up = 1 and down = 1").isEmpty()


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a long, b long) links -> (node, component): the smallest node reachable, for every node with a link.

    Links are first reduced to stars within partitions. Then two steps alternate until only stars are
    left: each node hands its larger neighbours to its smallest neighbour, then its smaller ones. Only minima are aggregated, so a node with very many
    links is pre-aggregated before the shuffle, and the link table shrinks to stars. Self links and
    repeats are dropped; an empty table gives an empty result.
    """
    links = cut(links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    links = cut(_local_stars(links))
    for _ in range(max_rounds):
        if _stars(links):
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = _nearest(both).select("a", F.least("a", "low").alias("low"))
        large = both.filter(F.col("b") > F.col("a")).join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = _nearest(large)
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter(F.col("a") != F.col("b"))
        links = cut(small.unionByName(low.select("a", F.col("low").alias("b"))).distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
