"""Connected components of an edge table.

Each task first reduces its edges to a spanning forest. What is left is counted: up to ``EDGES`` edges go through one task
(sixteen bytes each); more are contracted by alternating large-star and small-star steps, which
are two partially aggregated minima and two joins a round, cut to the shared folder; a vertex with very many
edges is a hot join key there that adaptive execution splits. Nothing is collected, and both ways give the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import cut

EDGES = 100_000
#: Edges of a task that are reduced at once.
HELD = 1 << 20


class Forest:
    """Which of some numbers are tied together; the least of them stands for all."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def tie(self, a: int, b: int) -> bool:
        """Whether that was new."""
        a, b = self.top(a), self.top(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b

    def edges(self) -> pa.RecordBatch:
        """Each number that isn't the least of its kind, with that."""
        lower = list(self.up)
        return pa.RecordBatch.from_arrays([pa.array(lower, pa.int64()), pa.array([self.top(x) for x in lower], pa.int64())], names=["u", "v"])


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = Forest()
    for batch in batches:
        ends = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
        for a, b in np.unique(ends, axis=1).T.tolist() if batch.num_rows else ():
            forest.tie(a, b)
        if len(forest.up) >= HELD:
            yield forest.edges()
            forest = Forest()
    yield forest.edges()


def components(edges: DataFrame, most: int = EDGES) -> DataFrame:
    """``(u, v)``: each vertex that has an edge and isn't its component's smallest, with that smallest vertex. Vertices are numbers."""
    edges = cut(edges.where("u <> v").select(F.col("u").cast("long"), F.col("v").cast("long")).mapInArrow(_forests, "u long, v long"))
    if edges.count() <= most:
        return cut(edges.coalesce(1).mapInArrow(_forests, "u long, v long"))
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Large star: each neighbour above a vertex is tied to the least around that vertex.
        large = cut(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # Small star: what a vertex is tied to is tied to the least of it.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        ties = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(ties.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = _state(edges)
        if now == state:
            return edges
        state = now


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(row)
