"""Connected components of an edge table."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifline.llm.common import Scratch, release


def _forest(rows):
    """Union-find over the rows (x, y) of one partition: a function that gives each node's least node."""
    up: dict = {}

    def root(x):
        at = x
        while (to := up.setdefault(at, at)) != at:
            at = to
        while up[x] != at:
            up[x], x = at, up[x]
        return at

    for x, y in rows:
        a, b = root(x), root(y)
        if a != b:
            up[max(a, b)] = min(a, b)
    return up, root


def _pairs(batches):
    for batch in batches:
        yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())


def components(scratch: Scratch, edges: DataFrame, name: str, rounds: int = 60, most: int = 100_000) -> DataFrame:
    """edges (a, b) to (node, root): every node of an edge, and the least node of its component.

    First each partition of the edges, whatever it holds, is replaced by stars on its own components' least nodes.
    If up to ``most`` rows remain, one task joins them. More are joined in rounds: rows (node, root) are dealt by node,
    so all roots that a node was given meet and are joined locally; and roots are replaced by their own roots. A node has
    one row from then on, so a component, however large, is spread over all tasks; the join by root has one row for each
    root on one side and is split where skewed. Rounds are written to the shared folder, which cuts the lineage.
    """
    kind = edges.schema["a"].dataType.simpleString()
    arrow = {"binary": pa.binary(), "bigint": pa.int64(), "string": pa.string()}[kind]

    def stars(batches):
        up, root = _forest(_pairs(batches))
        nodes = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, arrow), pa.array([root(x) for x in nodes], arrow)], ["x", "y"])
        del up, root, nodes
        release()

    def meet(batches):
        own = []

        def noted():
            for x, y in _pairs(batches):
                own.append(x)
                yield x, y

        up, root = _forest(noted())
        dealt = set(own)
        nodes = [x for x in up if x in dealt or root(x) != x]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, arrow), pa.array([root(x) for x in nodes], arrow), pa.array([x in dealt for x in nodes], pa.bool_())], ["x", "y", "own"])
        del up, root, nodes, dealt
        own.clear()
        release()

    rows = scratch.put(edges.select("a", "b").mapInArrow(stars, f"x {kind}, y {kind}"), f"{name}-0")
    if rows.count() <= most:
        one = scratch.put(rows.coalesce(1).mapInArrow(stars, f"x {kind}, y {kind}"), f"{name}-1")
        return one.select(F.col("x").alias("node"), F.col("y").alias("root"))
    for k in range(1, rounds + 1):
        met = scratch.put(rows.select("x", "y").repartition("x").mapInArrow(meet, f"x {kind}, y {kind}, own boolean"), f"{name}-{k}-met")
        own, links = met.where("own").select("x", "y"), met.where("NOT own").select("x", "y")
        jump = own.select(F.col("x").alias("y"), F.col("y").alias("z"))
        new = scratch.put(own.join(jump, "y").select("x", F.col("z").alias("y"), (F.col("y") != F.col("z")).alias("moved")), f"{name}-{k}")
        if not links.limit(1).count() and not new.where("moved").limit(1).count():
            return new.select(F.col("x").alias("node"), F.col("y").alias("root"))
        rows = new.select("x", "y").union(links)
    raise RuntimeError(f"no fixed point after {rounds} rounds")
