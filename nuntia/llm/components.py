"""Connected components of a graph in a DataFrame, by alternating large-star and small-star steps.

Each step lets every node point its neighbours at the smallest of them, with one aggregate and one join, so no
neighbour list is ever held in one place and the number of rounds grows with the logarithm of the graph's diameter.
Before a step's edges are dealt out, each task contracts its own, AT_ONCE at a time, to a star around the smallest node of
each part that they connect: fewer edges travel, and most chains are gone before the first round.

Defined results: edges with a null end and loops are left out; repeated edges count once; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nuntia.llm.common import discard, written

AT_ONCE = 1 << 19


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node connected with it) of the nodes of the edges (a, b), but for the smallest ones."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(label[label], label):
            label = label[label]
        differ = label[a] != label[b]
        a, b = a[differ], b[differ]
    other = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[other], nodes[label[other]]


def contracted(edges: DataFrame) -> DataFrame:
    """edges (a, b: long), contracted by each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(2)]))
            n += batch.num_rows
            if n >= AT_ONCE:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in contract(*np.concatenate(held, 1))], names=["a", "b"])
                held, n = [], 0
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in contract(*np.concatenate(held, 1))], names=["a", "b"])

    return edges.mapInArrow(run, "a long, b long")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and component (smallest node reachable) for every node with an edge (a, b: long) to another.

    The rounds end as soon as the edge set no longer changes; all edges then lead from a node to its component.
    """
    current = written(contracted(edges.where("a != b").select(F.col("a").cast("long"), F.col("b").cast("long"))).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        state = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            out = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
            out.nuntia_path = current.nuntia_path
            return out
        before = state
        # large star: neighbours above a node go to the smallest of node and neighbours
        both = current.union(current.select("b", "a"))
        # written first, so that the join deals out its own input and Spark can split a node of very many neighbours
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")), "least")
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: neighbours below a node, and the node, go to the smallest of them
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest.withColumnRenamed("a", "u"), F.col("a") == F.col("u")).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = written(contracted(small.union(lowest.select("a", F.col("m").alias("b")))).distinct(), "edges")
        discard(current)
        discard(least)
        current = after
    raise RuntimeError("the components have not settled")
