"""Connected components of an edge table, by alternating star contraction.

Each round is two aggregations and two joins over the remaining edges; the
edges of a round are written to the shared folder. Labels are the smallest
node. No adjacency list is ever collected: a node's neighbours only meet in
`min`, which Spark pre-aggregates. Nodes with a large share of all edges (`HUB_SHARE`, so
there are at most twice as many as its inverse) are known by their keys in each round, and their edges are dealt to
`SALTS` places in the joins back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import dropped, written
from .textkit import lean

EDGE = "a long, b long"
#: A node is a hub if it has this share of the edges, and HUB_EDGES at least.
HUB_SHARE, HUB_EDGES = 1 / 1000, 1000
SALTS = 64


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (root, node) with the same components as the edges given; roots are minima."""
    nodes, flat = np.unique(np.concatenate((a, b)), return_inverse=True)
    left, right = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        nxt = label.copy()
        np.minimum.at(nxt, left, low)
        np.minimum.at(nxt, right, low)
        np.minimum.at(nxt, label[left], low)
        np.minimum.at(nxt, label[right], low)
        while True:
            jump = nxt[nxt]
            if (jump == nxt).all():
                break
            nxt = jump
        if (nxt == label).all():
            break
        label = nxt
    moved = label != np.arange(len(nodes))
    return nodes[label[moved]], nodes[moved]


def _shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forests of the edges of a task, in pieces of bounded size."""
    keep: list[np.ndarray] = []
    size = 0

    def flush() -> pa.RecordBatch:
        a, b = forest(*(np.concatenate([x[i] for x in keep]) for i in (0, 1)))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        keep.append([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)])
        size += batch.num_rows
        if size > 2_000_000:
            yield flush()
            keep, size = [], 0
    if size:
        yield flush()


def _joined(rows: DataFrame, few: DataFrame, key: str, by: str, hubs: list[int]) -> DataFrame:
    """rows joined with few, which has one row a key; the rows of hubs are dealt by `by`."""
    if not hubs:
        return rows.join(few, key)
    hot = F.col(key).isin(hubs)
    dealt = rows.withColumn("_salt", F.when(hot, F.pmod(F.xxhash64(by), F.lit(SALTS))).otherwise(F.lit(0).cast("long")))
    spread = few.withColumn("_salt", F.explode(F.when(hot, F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))))
    return dealt.join(spread, [key, "_salt"]).drop("_salt")


def components(edges: DataFrame, shrink: bool = True) -> DataFrame:
    """(node, component) for every node of the undirected edges (a long, b long).

    shrink: forests are made of each task's edges first; of no use where the edges come as forests.

    Component is its smallest node. Self loops are kept as nodes only if another
    edge has them; nulls take no part; repeated edges change nothing.
    """
    edges = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    if shrink:
        edges = edges.mapInArrow(lean(_shrink), EDGE)
    now, state = written(edges, "edges"), None
    while True:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least_edges = max(HUB_EDGES, int(now.count() * HUB_SHARE))
        hubs = [r["a"] for r in both.groupBy("a").count().where(F.col("count") >= least_edges).collect()]
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        star = _joined(both.where("b > a"), low, "a", "b", hubs).select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # each node's smaller neighbours all move to its smallest
        least = star.groupBy("b").agg(F.min("a").alias("m"))
        down = _joined(star, least, "b", "a", hubs).select(F.col("m").alias("a"), F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a")).alias("b"))
        nxt = written(down.where("a <> b").distinct(), "edges")
        got = nxt.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        dropped(now)
        now = nxt
        if (got.n, got.h) == state:
            break
        state = (got.n, got.h)
    roots = now.select(F.col("a").alias("node")).distinct()
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(roots.select("node", F.col("node").alias("component")))
