"""Distributed union-find: connected components by alternating large-star and
small-star steps (Kiveris et al., "Connected Components in MapReduce and
Beyond").  Every step is a grouped minimum joined back to the edges, so no
node's neighbours are ever gathered in one task; the edges are written to the
shared folder between steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (both.join(low, "a").where((F.col("b") > F.col("a")) & (F.col("b") != F.col("m")))
            .select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = (down.join(low, "a").where(F.col("b") != F.col("m"))
             .select(F.col("b").alias("a"), F.col("m").alias("b")))
    return moved.union(low.select("a", F.col("m").alias("b")))


def _state(e: DataFrame) -> tuple:
    row = e.agg(F.count("*").alias("n"),
                F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` for every node that has an edge to another node;
    ``component`` is the smallest node of its component (itself included).

    Edges may repeat, run in either direction and hold self loops; rows with a
    NULL end are no edges.  Nodes can be of any orderable type.  No edges: an
    empty frame.
    """
    e = materialize(
        edges.select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b"))
        .where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
        .distinct(), "cc")
    state = _state(e)
    while state[0]:
        nxt = materialize(_small_star(_large_star(e).distinct()).distinct(), "cc")
        forget(e)
        e, last, state = nxt, state, _state(nxt)
        if state == last:
            break
    roots = e.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
