"""Connected components of a graph whose edges are a DataFrame.

Every task first contracts what it has of the edges, a bounded number at a time: of each piece only links to the least
node of its own groups stay, which connect the same nodes. Alternating large-star and small-star steps
(Kiveris et al., 2014) then connect the pieces: each step is a minimum by node and a join, so no neighbour list is ever
gathered; a hub's edges stay in the tasks that read them, as minima of the few nodes with very many edges are broadcast.
Every step is written to the shared folder, so neither plans nor recomputation grow with the rounds; there are
few queries, each of a scan or two, an aggregate or a join, so there is little that the driver has to plan, send and keep.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe.llm.common import durable, partitions

#: Edges that one file of a round's table holds, about.
EDGES_A_FILE = 2_000_000
#: Edges that a task contracts at a time (some 300 bytes each).
PIECE = 200_000


def components(edges: DataFrame, piece: int = PIECE) -> DataFrame:
    """edges: two columns a, b of one type that has an order. Returns node, root for each node that
    has an edge to another; root is the least node of its component. Self loops and nulls don't count."""
    edges = durable(edges.where("a <> b").select("a", "b"), "edges")
    rows, tasks = edges.count(), partitions(edges.sparkSession)
    files, limit = min(tasks, rows // EDGES_A_FILE + 1), max(256, rows // tasks)
    now = _contracted(edges, files, piece)
    while True:
        both = now.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(now.select(F.col("b").alias("node"), F.col("a").alias("other")))
        least = F.min("other")
        near = both.groupBy("node").agg(F.least(F.col("node"), least).alias("m"), F.count("*").alias("n"), ((least < F.col("node")) & (least < F.max("other"))).alias("open"))
        near = durable(near, "neighbours", files)
        if not near.where("open").limit(1).count():
            break  # all nodes but roots have one neighbour, which then is a root
        # larger neighbours of a node go to the least of it and its neighbours
        large = durable(_with_least(now, near, "b", limit).select("a", F.col("m").alias("b")), "edges", files)
        lower = durable(large.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"), F.count("*").alias("n")), "neighbours", files)
        # so do a node and its smaller neighbours
        rest = _with_least(large, lower, "a", limit).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = _contracted(lower.select(F.col("node").alias("a"), F.col("m").alias("b")).unionByName(rest).distinct(), files, piece)
    return near.where("m <> node").select("node", F.col("m").alias("root"))


def _contracted(edges: DataFrame, files: int, piece: int) -> DataFrame:
    """Edges (a over b) that connect the same nodes, contracted in as many tasks as files."""

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, piece):
                held.append(part := batch.slice(at, piece))
                n += part.num_rows
                if n >= piece:
                    yield _stars(held)
                    held, n = [], 0
        if held:
            yield _stars(held)

    return durable(edges.repartition(files).mapInArrow(stars, edges.schema), "edges")


def _stars(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Each node that these edges connect with a smaller one, and the least node that they connect it with."""
    parent: dict = {}

    def root(v):
        while (up := parent.get(v, v)) != v:
            parent[v] = v = parent.get(up, up)
        return v

    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
    nodes, kind = list(parent), batches[0].schema
    return pa.record_batch([pa.array(nodes, kind.field(0).type), pa.array([root(v) for v in nodes], kind.field(1).type)], ["a", "b"])


def _with_least(edges: DataFrame, nodes: DataFrame, key: str, limit: int) -> DataFrame:
    """edges with m of the node that `key` names. nodes: node, m and n, how many edges it has, at least. Those with over `limit`
    edges are no more than a few for each task, and are broadcast; the others are joined on the node. Both tables are
    read more than once."""
    hubs = nodes.where(F.col("n") > limit).select(F.col("node").alias("_hub"), F.col("m").alias("_m"))
    told = edges.join(F.broadcast(hubs), edges[key] == F.col("_hub"), "left")
    of_hubs = told.where("_hub is not null").select("a", "b", F.col("_m").alias("m"))
    others = told.where("_hub is null").select("a", "b").join(nodes.where(F.col("n") <= limit), F.col(key) == F.col("node"))
    return of_hubs.unionByName(others.select("a", "b", "m"))
