"""Exact single linkage of all rows (K3): the Euclidean minimum spanning tree.

Boruvka's rounds on Spark: every component takes its shortest edge to another
one, the components along those edges are contracted, until one is left.  The
shortest edges come from a search that never lists all pairs:

* The distinct rows (copies merge at height 0 at once) are put on a Morton curve;
  its prefixes are the nodes of a tree, split until a node has at most ``CELL``
  rows, a cell.  Every node knows its box, and per round whether its rows are of
  one component.
* Before the first round every cell merges its own rows, as long as a component's
  shortest edge inside the cell is shorter than its way to the cell's border: no
  row outside can be nearer.  Only components near a border are left.
* A piece is the rows of one component in one cell.  Its shortest edge inside the cell
  bounds the search outside: level by level, pairs of a piece and a node are
  split, and dropped if the node is all of the piece's component or further away than
  a distance within which the component surely has another one.  Of the cells
  that remain only the rows within that distance of the piece are sent to it.

All steps are joins, grouped aggregates and numpy on one cell with the rows near it;
between levels and rounds tables are written to the shared folder.  Dense spots
deepen the tree instead of widening a task.  Rows that agree in all bits of the
curve (60 bits in all, so 60 / number of features per feature) share a cell whatever
their number, and with many features boxes tell little apart: it is a method for
few features.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tally.functions.stats import as_col
from tally.operators.cluster import vectors
from tally.session import ship_package, written

CELL = 2048   # rows of a cell, a leaf of the tree
CHUNK = 1 << 21  # distances held at once
SPLIT = 4     # bits by which a level splits a node
BITS = 60     # bits of the curve
SLACK = 1e-9  # relative rounding of a bound


def _points(df: DataFrame, xs: Sequence[str], key: str, scale: bool) -> DataFrame:
    return vectors(df.select(as_col(key).alias("id"), *[as_col(x).alias(f"x{i}") for i, x in enumerate(xs)]),
                   [f"x{i}" for i in range(len(xs))], ["id"], scale).select("id", vector_to_array("features").alias("x"))


def _curve(points: DataFrame, dims: int) -> tuple[DataFrame, int, list[tuple[float, float]]]:
    """Adds ``code``, the place on the Morton curve, and says how many bits it has and between which values."""
    per = max(BITS // dims, 1)
    used = min(dims, BITS)
    lo = [F.min(F.col("x")[i]).alias(f"l{i}") for i in range(used)]
    hi = [F.max(F.col("x")[i]).alias(f"h{i}") for i in range(used)]
    ends = points.agg(*lo, *hi).first()  # two numbers per feature
    box = points.sparkSession.createDataFrame([tuple(ends)], ", ".join(f"{c} double" for c in ends.asDict()))
    cells = [F.when(F.col(f"h{i}") > F.col(f"l{i}"), F.floor((F.col("x")[i] - F.col(f"l{i}")) / (F.col(f"h{i}") - F.col(f"l{i}"))
                                                              * ((1 << per) - 1))).otherwise(F.lit(0)).cast("long") for i in range(used)]
    code = F.lit(0).cast("long")
    placed = points.crossJoin(F.broadcast(box)).select("id", "x", *[c.alias(f"c{i}") for i, c in enumerate(cells)])  # one row
    for b in range(per):
        for i in range(used):
            bit = F.shiftright(F.col(f"c{i}"), b).bitwiseAND(F.lit(1).cast("long"))
            code = code.bitwiseOR(F.shiftleft(bit, b * used + i))
    total = per * used
    return placed.select("id", "x", F.shiftright(code, total % SPLIT).alias("code")), total - total % SPLIT, [
        (ends[f"l{i}"], ends[f"h{i}"]) for i in range(used)]


def _tree(points: DataFrame, dims: int) -> tuple[DataFrame, DataFrame, int, list[tuple[float, float]]]:
    """``(nodes, rows, depth, ends)``: ``node, leaf, lo, hi`` and ``id, x, leaf`` (the leaf that holds the row).
    A node's number is 1 followed by its prefix of the curve, so its parent's is ``node >> SPLIT``."""
    coded, bits, ends = _curve(points, dims)
    rest, nodes, rows, level = written(coded, "linkage-points"), None, None, 0
    while True:
        at = F.shiftright("code", bits - level) + (1 << level)
        box = rest.groupBy(at.alias("node")).agg(
            (F.count(F.lit(1)) <= (CELL if level < bits else 1 << 62)).alias("leaf"),
            F.array(*[F.min(F.col("x")[i]) for i in range(dims)]).alias("lo"),
            F.array(*[F.max(F.col("x")[i]) for i in range(dims)]).alias("hi"))
        box = written(box, "linkage-nodes")
        nodes = box if nodes is None else nodes.unionByName(box)
        told = rest.withColumn("node", at).join(box.select("node", "leaf"), "node")
        done = told.where("leaf").select("id", "x", F.col("node").alias("leaf"))
        rows = done if rows is None else rows.unionByName(done)
        if not box.where(~F.col("leaf")).take(1):
            return written(nodes, "linkage-nodes"), written(rows, "linkage-rows"), level // SPLIT, ends
        rest = written(told.where(~F.col("leaf")).select("id", "x", "code"), "linkage-points")
        level += SPLIT


def _squared(terms: Sequence[Column]) -> Column:
    out = F.lit(0.0)
    for t in terms:
        out = out + t * t
    return out


def _gap(q: str, r: str, dims: int) -> Column:
    """Least squared distance of two boxes."""
    lo, hi = (lambda b, i: F.col(f"{b}.lo")[i]), (lambda b, i: F.col(f"{b}.hi")[i])
    return _squared([F.greatest(lo(q, i) - hi(r, i), lo(r, i) - hi(q, i), F.lit(0.0)) for i in range(dims)])


def _reach(q: str, r: str, dims: int) -> Column:
    """Greatest squared distance of two boxes."""
    lo, hi = (lambda b, i: F.col(f"{b}.lo")[i]), (lambda b, i: F.col(f"{b}.hi")[i])
    return _squared([F.greatest(F.abs(hi(q, i) - lo(r, i)), F.abs(hi(r, i) - lo(q, i))) for i in range(dims)])


def _node_components(nodes: DataFrame, rows: DataFrame, depth: int) -> DataFrame:
    """``node, leaf, lo, hi, one``: ``one`` is the component of all the node's rows, NULL if there are several."""
    of_leaf = rows.groupBy("leaf").agg(F.min("comp").alias("a"), F.max("comp").alias("b"))
    ancestors = F.array(*[F.shiftright("leaf", SPLIT * i) for i in range(depth + 1)])
    up = of_leaf.select("a", "b", F.explode(ancestors).alias("node")).where(F.col("node") > 0)
    of_node = up.groupBy("node").agg(F.when(F.min("a") == F.max("b"), F.min("a")).alias("one"))
    return nodes.join(of_node, "node")


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``x`` to all of ``y``, summed as :func:`_squared` does."""
    out = np.zeros((len(x), len(y)))
    for i in range(x.shape[1]):
        t = x[:, i, None] - y[None, :, i]
        out += t * t
    return out


def _least(xa, ca, ra, xb, cb, rb) -> tuple[np.ndarray, ...]:
    """Of every component among ``ca`` the least edge to a row of ``b`` of another one, by the distance and the
    ranks ``r`` of the ends: ``(d2, i, j)``, rows of ``a`` and ``b``."""
    found = []
    step = max(CHUNK // max(len(xb), 1), 1)
    for begin in range(0, len(xa), step):
        d2 = _distances(xa[begin:begin + step], xb)
        d2[ca[begin:begin + step, None] == cb[None, :]] = np.inf
        least = d2.min(axis=1, initial=np.inf)
        i, j = np.nonzero((d2 == least[:, None]) & np.isfinite(least)[:, None])
        found.append((least[i], i + begin, j))
    d2, i, j = (np.concatenate([f[k] for f in found]) for k in range(3))
    order = np.lexsort((np.maximum(ra[i], rb[j]), np.minimum(ra[i], rb[j]), d2, ca[i]))
    first = order[np.concatenate([[True], np.diff(ca[i][order]) != 0])] if len(order) else order
    return d2[first], i[first], j[first]


def _spanning(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(d2, a, b)`` of the minimum spanning tree of rows in the order of their keys, ascending; a < b (Prim)."""
    n = len(x)
    near, by, done = np.full(n, np.inf), np.full(n, np.iinfo(np.int64).max), np.zeros(n, bool)
    at, i, out = np.arange(n), 0, []
    for _ in range(n - 1):
        done[i] = True
        d2, edge = _distances(x[i:i + 1], x)[0], np.minimum(i, at) * n + np.maximum(i, at)
        take = ~done & ((d2 < near) | ((d2 == near) & (edge < by)))
        near[take], by[take] = d2[take], edge[take]
        near[i] = np.inf
        best = np.flatnonzero(~done & (near == near.min()))
        i = int(best[by[best].argmin()])
        out.append((near[i], by[i]))
    d2, edge = np.array([o[0] for o in out]), np.array([o[1] for o in out], dtype=np.int64)
    order = np.lexsort((edge, d2))
    return d2[order], edge[order] // n, edge[order] % n


def _to_border(x: np.ndarray, leaf: int, ends: Sequence[tuple[float, float]]) -> np.ndarray:
    """At least how far every row of a cell is from the places that are not the cell's."""
    used, level = len(ends), leaf.bit_length() - 1
    per = max(BITS // used, 1)
    out = np.full(len(x), np.inf)
    for i, (lo, hi) in enumerate(ends):
        known = sum(1 for place in range(per * used - level, per * used) if place % used == i)
        if hi <= lo or not known:
            continue
        cell = np.floor((x[0, i] - lo) / (hi - lo) * ((1 << per) - 1))
        size = 1 << (per - known)
        begin = int(cell) // size * size
        unit, slack = (hi - lo) / ((1 << per) - 1), 1e-12 * (abs(lo) + abs(hi))
        if begin > 0:
            out = np.minimum(out, x[:, i] - (lo + begin * unit) - slack)
        if begin + size < 1 << per:
            out = np.minimum(out, lo + (begin + size) * unit - x[:, i] - slack)
    return np.maximum(out, 0.0)


def _merge_inside(x: np.ndarray, leaf: int, ends: Sequence[tuple[float, float]]) -> tuple[np.ndarray, list[tuple]]:
    """The component of every row of a cell (its first row) and the edges ``(a, b, d2)`` that merged them: those
    that are a component's shortest whatever lies outside the cell."""
    d2, a, b = _spanning(x)
    comp, border = np.arange(len(x)), _to_border(x, leaf, ends) ** 2 * (1 - SLACK)
    left, edges = np.arange(len(d2)), []
    while len(left):
        first = np.full(len(x), len(d2))
        np.minimum.at(first, comp[a[left]], left)
        np.minimum.at(first, comp[b[left]], left)
        sure = np.flatnonzero(first < len(d2))
        sure = np.unique(first[sure[d2[first[sure]] < border[sure]]])  # edges are numbered in their order
        if not len(sure):
            break
        for e in sure:
            p, q = sorted((int(comp[a[e]]), int(comp[b[e]])))
            comp[comp == q] = p
            border[p] = min(border[p], border[q])
            edges.append((int(a[e]), int(b[e]), float(d2[e])))
        left = left[comp[a[left]] != comp[b[left]]]
    return comp, edges


def _inside(rows: DataFrame, ends: Sequence[tuple[float, float]]) -> DataFrame:
    """``id, x, leaf, comp`` with the edge ``a, b, d2`` on as many rows as a cell has merged."""
    id_type = rows.schema["id"].dataType
    schema = T.StructType([*rows.schema.fields, T.StructField("comp", id_type), T.StructField("a", id_type),
                           T.StructField("b", id_type), T.StructField("d2", T.DoubleType())])

    def merge(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("id", ignore_index=True)
        ids = t["id"].to_numpy()
        comp, edges = _merge_inside(np.stack(t["x"].to_numpy()), int(t["leaf"].iloc[0]), ends)
        rest = [None] * (len(t) - len(edges))
        return t[["x", "leaf"]].assign(id=ids, comp=ids[comp], a=pd.Series([ids[e[0]] for e in edges] + rest, dtype=object),
                                             b=pd.Series([ids[e[1]] for e in edges] + rest, dtype=object),
                                             d2=pd.Series([e[2] for e in edges] + rest, dtype=object))

    return rows.select("id", "x", "leaf").groupBy("leaf").applyInPandas(merge, schema)


def _edge_schema(rows: DataFrame) -> T.StructType:
    id_type = rows.schema["id"].dataType
    return T.StructType([T.StructField("comp", id_type), T.StructField("d2", T.DoubleType()), T.StructField("a", id_type),
                         T.StructField("b", id_type), T.StructField("to", id_type)])


def _edges(own: pd.DataFrame, far: pd.DataFrame) -> pd.DataFrame:
    """The least edges of the components of ``own`` to rows of ``far``."""
    ranks = pd.factorize(np.concatenate([own["id"].to_numpy(), far["id"].to_numpy()]), sort=True)[0]
    comps = pd.factorize(np.concatenate([own["comp"].to_numpy(), far["comp"].to_numpy()]))[0]
    n = len(own)
    d2, i, j = _least(np.stack(own["x"].to_numpy()), comps[:n], ranks[:n], np.stack(far["x"].to_numpy()), comps[n:], ranks[n:])
    a, b = own["id"].to_numpy()[i], far["id"].to_numpy()[j]
    swap = ranks[:n][i] > ranks[n:][j]
    return pd.DataFrame({"comp": own["comp"].to_numpy()[i], "d2": d2, "a": np.where(swap, b, a), "b": np.where(swap, a, b),
                         "to": far["comp"].to_numpy()[j]})


def _least_of(edges: DataFrame) -> DataFrame:
    """``comp, edge(d2, a, b), to``: of every component the least edge."""
    return edges.groupBy("comp").agg(F.min(F.struct(F.struct("d2", "a", "b").alias("edge"), "to")).alias("m")).select("comp", "m.*")


def _least_inside(rows: DataFrame) -> DataFrame:
    """The least edge of every component within a cell; a cell of one component has none."""
    schema = _edge_schema(rows)

    def search(t: pd.DataFrame) -> pd.DataFrame:
        return _edges(t, t) if t["comp"].nunique() > 1 else pd.DataFrame(columns=schema.names, dtype=object)

    return _least_of(rows.select("id", "x", "leaf", "comp").groupBy("leaf").applyInPandas(search, schema))


def _near(nodes: DataFrame, rows: DataFrame, own: DataFrame, depth: int, dims: int) -> DataFrame:
    """``a(leaf, comp, lo, hi, most), r``: pieces and the other cells that may hold a row nearer to the piece than
    the shortest edge that its component is known to have."""
    info = written(_node_components(nodes, rows, depth), "linkage-info")
    kid = F.struct("node", "lo", "hi", "one").alias("b")
    kids = info.select(F.shiftright("node", SPLIT).alias("r"), kid).where("r > 0").unionByName(
        info.where("leaf").select(F.col("node").alias("r"), kid))
    pieces = rows.groupBy("leaf", "comp").agg(F.array(*[F.min(F.col("x")[i]) for i in range(dims)]).alias("lo"),
                                              F.array(*[F.max(F.col("x")[i]) for i in range(dims)]).alias("hi"))
    front = pieces.join(own.select("comp", F.col("edge.d2").alias("most")), "comp", "left").select(
        F.struct("leaf", "comp", "lo", "hi", "most").alias("a"), F.lit(1).cast("long").alias("r"))
    for _ in range(max(depth, 1)):
        # every node left has a row of another component
        pairs = front.join(kids, "r").where((F.col("b.node") != F.col("a.leaf")) & ~F.col("b.one").eqNullSafe(F.col("a.comp"))).select(
            "a", F.col("b.node").alias("r"), _gap("a", "b", dims).alias("lo"), _reach("a", "b", dims).alias("hi")).where(
            F.col("a.most").isNull() | (F.col("lo") <= F.col("a.most") * (1 + SLACK)))
        within = pairs.groupBy(F.col("a.comp").alias("comp")).agg(F.min("hi").alias("within"))
        kept = pairs.join(within, F.col("a.comp") == F.col("comp")).withColumn("most", F.least("a.most", "within")).where(
            F.col("lo") <= F.col("most") * (1 + SLACK))
        front = written(kept.select(F.struct("a.leaf", "a.comp", "a.lo", "a.hi", "most").alias("a"), "r"), "linkage-front")
    return front


def _sent(front: DataFrame, rows: DataFrame, dims: int) -> DataFrame:
    """``q, of, fid, fx, fcomp``: the rows of other components near the piece ``of`` of cell ``q``."""
    at = [F.greatest(F.col("a.lo")[i] - F.col("x")[i], F.col("x")[i] - F.col("a.hi")[i], F.lit(0.0)) for i in range(dims)]
    return front.join(rows.withColumnRenamed("leaf", "r"), "r").where(
        (F.col("comp") != F.col("a.comp")) & (_squared(at) <= F.col("a.most") * (1 + SLACK))).select(
        F.col("a.leaf").alias("q"), F.col("a.comp").alias("of"), F.col("id").alias("fid"), F.col("x").alias("fx"), F.col("comp").alias("fcomp"))


def _shortest(nodes: DataFrame, rows: DataFrame, depth: int, dims: int) -> DataFrame:
    """``comp, edge(d2, a, b), to``: the least edge of every component that leads to another one; ties by the ends' ids."""
    schema = _edge_schema(rows)
    own = written(_least_inside(rows), "linkage-own")
    if not depth:
        return own
    front = _near(nodes, rows, own, depth, dims)
    asking = front.select("a.leaf", "a.comp").distinct()

    def search(key: tuple, t: pd.DataFrame, far: pd.DataFrame) -> pd.DataFrame:
        mine, far = dict(list(t.groupby("comp", sort=False))), far.rename(columns={"fid": "id", "fx": "x", "fcomp": "comp"})
        found = [_edges(mine[c], f) for c, f in far.groupby("of", sort=False)]
        return pd.concat(found) if found else pd.DataFrame(columns=schema.names, dtype=object)

    outside = rows.select("id", "x", "leaf", "comp").join(asking, ["leaf", "comp"], "left_semi").groupBy("leaf").cogroup(
        _sent(front, rows.select("id", "x", "leaf", "comp"), dims).groupBy("q")).applyInPandas(search, schema)
    return _least_of(own.select("comp", "edge.*", "to").unionByName(outside))


def contracted(best: DataFrame) -> DataFrame:
    """``comp, to``: the representative of every component after following its chosen edge (``comp, to``,
    from files) to the end.  Edges are chosen by one order of all edges, so the only circles are pairs
    that chose the same edge; the smaller of the two stands for the tree."""
    back = best.select(F.col("comp").alias("to"), F.col("to").alias("back"))
    p = best.select("comp", "to").join(back, "to", "left").select("comp", F.when(
        (F.col("back") == F.col("comp")) & (F.col("comp") < F.col("to")), F.col("comp")).otherwise(F.col("to")).alias("to"))
    p = written(p, "linkage-parents")
    while True:
        far = p.join(p.select(F.col("comp").alias("to"), F.col("to").alias("next")), "to").select("comp", F.col("next").alias("to"))
        end = far.join(far.select(F.col("comp").alias("to"), F.col("to").alias("next")), "to").select(
            "comp", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved"))
        p = written(end, "linkage-parents")  # four times as far as before
        if not p.where("moved").take(1):
            return p.select("comp", "to")
        p = p.select("comp", "to")


def single_linkage(df: DataFrame, xs: Sequence[str], key: str, scale: bool = True) -> DataFrame:
    """The merges of single linkage over all rows: ``(a, b, height)``, one row less than there are
    rows; sorted by height they are the dendrogram, cut by :func:`cut`.  ``a`` and ``b`` are keys, ``a < b``.

    Keys are unique and not NULL; rows with a NULL or NaN feature are left out; features are divided by
    their standard deviation when ``scale``.  Equal distances are taken by the order of the keys."""
    dims = len(xs)
    points = written(_points(df, xs, key, scale).where(F.col("id").isNotNull()), "linkage-rows")
    firsts = written(points.groupBy("x").agg(F.min("id").alias("id")), "linkage-distinct")
    copies = points.join(firsts.select("x", F.col("id").alias("a")), "x").where(F.col("id") != F.col("a"))
    merges = [copies.select("a", F.col("id").alias("b"), F.lit(0.0).alias("height"))]
    if firsts.take(1):
        ship_package(df.sparkSession)
        nodes, rows, depth, ends = _tree(firsts, dims)
        inside = written(_inside(rows, ends), "linkage-inside")
        merges.append(inside.where("d2 is not null").select("a", "b", F.sqrt("d2").alias("height")))
        rows = inside.select("id", "x", "leaf", "comp")
        while True:
            best = written(_shortest(nodes, rows, depth, dims), "linkage-best")
            if not best.take(1):
                break
            merges.append(best.select("edge").distinct().select("edge.a", "edge.b", F.sqrt("edge.d2").alias("height")))
            rows = written(rows.join(contracted(best), "comp").select("id", "x", "leaf", F.col("to").alias("comp")), "linkage-rows")
    out = merges[0]
    for m in merges[1:]:
        out = out.unionByName(m)
    return out


def cut(merges: DataFrame, keys: DataFrame, k: int | None = None, height: float | None = None) -> DataFrame:
    """``(key, cluster)`` of every row of ``keys`` (one column): the groups that are left when the ``k - 1``
    highest merges, or those above ``height``, are undone; ``cluster`` is the group's smallest key."""
    if (k is None) == (height is None):
        raise ValueError("give k or height")
    key = keys.columns[0]
    if k is not None:  # the k - 1 highest, a bounded list
        undone = merges.orderBy(F.col("height").desc(), F.col("a").desc(), F.col("b").desc()).limit(k - 1)
        left = merges.join(undone, ["a", "b"], "left_anti")
    else:
        left = merges.where(F.col("height") <= height)
    edges = written(left.select("a", "b", F.col("a").alias("ca"), F.col("b").alias("cb")), "linkage-cut")
    rows = written(keys.select(as_col(key).alias("id"), as_col(key).alias("comp")), "linkage-cut")
    while edges.take(1):
        both = edges.select("a", "b", F.col("ca").alias("comp"), F.col("cb").alias("to")).unionByName(
            edges.select("a", "b", F.col("cb").alias("comp"), F.col("ca").alias("to")))
        best = both.groupBy("comp").agg(F.min(F.struct("a", "b", "to")).alias("m")).select("comp", "m.to")
        new = contracted(written(best, "linkage-cut"))
        rows = written(rows.join(new, "comp", "left").select("id", F.coalesce("to", "comp").alias("comp")), "linkage-cut")
        for c in ("ca", "cb"):
            edges = edges.join(new.select(F.col("comp").alias(c), F.col("to").alias("_t")), c).drop(c).withColumnRenamed("_t", c)
        edges = written(edges.where("ca <> cb").select("a", "b", "ca", "cb"), "linkage-cut")
    first = rows.groupBy("comp").agg(F.min("id").alias("cluster"))
    return rows.join(first, "comp").select(F.col("id").alias(key), "cluster")
