"""Connected components: few links by a union of labels on the driver, more by alternating large and small stars.

A star's round is minima and joins, no neighbour list in one place: some eight shuffles, each with a task a partition, of
which the driver keeps records. For links that fit into FEW rows that outweighs the links many times over, so that these
are settled where they are counted. Both ways give the same components.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclith.llm.shared import Drafts, keep

#: Links that the driver settles: 2 MB at most.
FEW = 1 << 17


def _settled(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes and the least node that each reaches. The higher of two linked roots goes below the lower one, and all
    nodes below their roots, until no link joins two roots."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while (apart := root[a] != root[b]).any():
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while ((above := root[root]) != root).any():
            root = above
    return nodes, nodes[root]


def _both(links: DataFrame, first: tuple[str, str], second: tuple[str, str]) -> DataFrame:
    """Two links (u, v) of each row, which is made once."""
    pair = lambda x, y: F.struct(F.col(x).alias("u"), F.col(y).alias("v"))
    return links.select(F.explode(F.array(pair(*first), pair(*second))).alias("_l")).select("_l.u", "_l.v")


def _minimum(links: DataFrame) -> DataFrame:
    """For links (u, v): u, v and m, the least of u and all its v. A hot u is a hot join key, which Spark can split."""
    least = links.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("m"))
    return links.join(least, F.col("u") == F.col("_u")).select("u", "v", F.least("u", "m").alias("m"))


def _stars(links: DataFrame, write: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """node, component by stars; each round is written, and goes when the next one is."""
    drafts = Drafts(links.sparkSession)
    edges = drafts.keep(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components")
    before = None
    while True:
        large = _minimum(_both(edges, ("u", "v"), ("v", "u"))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        done, drafts = drafts, Drafts(links.sparkSession)
        edges = drafts.keep(_both(_minimum(large), ("v", "m"), ("u", "m")).where("u != v").distinct(), "components")
        done.remove()
        now = edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == before:
            break
        before = now
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    out = write(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots), "components")
    drafts.remove()
    return out


def components(links: DataFrame, write: Callable[[DataFrame, str], DataFrame] = keep) -> DataFrame:
    """node, component (the least node that links reach) of every node in links (u, v), longs, as a table that ``write``
    writes. A node that is linked with itself only is not in it. links is read twice: a table."""
    links = links.where("u != v").select("u", "v")
    if links.count() > FEW:
        return _stars(links, write)
    found = links.toArrow()
    nodes, component = _settled(found["u"].to_numpy(), found["v"].to_numpy())
    return write(links.sparkSession.createDataFrame(pa.table({"node": pa.array(nodes, pa.int64()), "component": pa.array(component, pa.int64())})), "components")
