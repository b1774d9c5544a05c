"""Merkle manifest of a table: a leaf per row, a tree per group, a tree over the groups, a proof per row.

A row's rank within its group, written in base ``arity``, names its place in
the tree.  The lowest ``digits`` digits place it inside a block of at most
``arity ** digits`` nodes; the others name the block.  Inside a block the digit
columns are grouped away one after the other, lowest first, and every group
nests its children's structs, so a block ends as one row that holds its
subtree.  All those groupings are on supersets of the block's key: one shuffle
a tier.  Block roots are the nodes of the next tier, until a group has one.

Proofs are made on the way down: a block row meets the path of its root (a
union and a grouping, no join), a nested transform hands the path to every
child with its siblings put in front, and explode gives the rows back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, let, materialize

#: Digits of a block: 2 ** 8 leaves at arity 2.
DIGITS = 8


def digest(text: Column) -> Column:
    """Lowercase hex SHA-256."""
    return F.sha2(text, 256)


def leaf(columns: Sequence[Column]) -> Column:
    """Digest of the values in turn: ``-`` for NULL, else UTF-8 byte count, ``:``, value."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
             for c in columns]
    return digest(F.concat(*parts))


def ranked(rows: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds ``rank`` (from 0, by ``order`` within ``group``) and ``n`` (rows of the group).

    The rows are dealt in ranges of (group, order), so no task holds a group; a range's
    counts per group (at most ranges + groups rows) give the rank at which it begins.  Rows that
    are equal in ``order`` may share a range's border: they must be alike or told apart by ``order``."""
    dealt = rows.repartitionByRange(*[F.col(c) for c in (*group, *order)]).sortWithinPartitions(*group, *order)
    place = F.monotonically_increasing_id()  # range number and place within it
    dealt = materialize(dealt.withColumn("_place", place), "merkle-ranges")
    part = F.shiftright("_place", 33).alias("_part")
    counts = dealt.groupBy(*group, part).agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], "_part", "_first",
                           F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
                           F.sum("_rows").over(Window.partitionBy(*group)).alias("n"))
    same = F.col("_part") == F.shiftright("_place", 33)
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return dealt.join(counts, same).select(
        *rows.columns, (F.col("_before") + F.col("_place") - F.col("_first")).alias("rank"), "n")


def nested(nodes: DataFrame, group: Sequence[str], arity: int, digits: int) -> DataFrame:
    """One tier: ``(group, block, n, node)`` from ``(group, rank, n, node)`` where ``node`` is a struct
    with the digest ``h``.  The result's node is ``(h, kids)``, nested ``digits`` levels deep.

    A level stands only while more than one node remains (``n > arity ** (level - 1)``): a last
    run of fewer nodes is digested too, a single remaining node is not."""
    size = arity ** digits
    rows = nodes.select(*group, F.expr(f"rank div {size}").alias("block"), "n", F.col("node"), *[
        F.pmod(F.expr(f"rank div {arity ** i}"), F.lit(arity)).cast("int").alias(f"d{i}") for i in range(digits)])
    rows = rows.repartition(*group, "block")
    for i in range(digits):
        keys = [*group, "block", *[f"d{j}" for j in range(i + 1, digits)]]
        kids = F.array_sort(F.collect_list(F.struct(F.col(f"d{i}").alias("d"), "node.*")))
        rows = rows.groupBy(*keys).agg(F.max("n").alias("n"), kids.alias("kids"))
        h = F.when(F.col("n") > arity ** i, digest(F.array_join(F.transform("kids", lambda k: k.h), ""))).otherwise(
            F.col("kids")[0].h)
        rows = rows.select(*keys, "n", F.struct(h.alias("h"), "kids").alias("node"))
    return rows


def _handed_down(node: Column, n: Column, path: Column, arity: int, level: int, leaf_of) -> Column:
    """Leaves of ``node`` (whose kids are the nodes of ``level``), each with its path upwards."""
    def child(k: Column) -> Column:
        def beside(at_left: bool) -> Column:
            some = F.filter(node.kids, lambda x: x.d < k.d if at_left else x.d > k.d)
            return F.array_join(F.transform(some, lambda x: x.h), "")
        step = F.array(F.struct(beside(True).alias("left"), beside(False).alias("right")))
        below = F.when(n > arity ** level, F.concat(step, path)).otherwise(path)
        if not level:
            return F.array(leaf_of(k, below))
        return let(below, lambda p: _handed_down(k, n, p, arity, level - 1, leaf_of))
    return F.flatten(F.transform(node.kids, child))


_PATH = "array<struct<left: string, right: string>>"


class Tree:
    """The tiers of one tree over ``rows`` (``group``, ``order``, digest column ``h`` and any others)."""

    def __init__(self, rows: DataFrame, group: Sequence[str], order: Sequence[str], arity: int, digits: int) -> None:
        self.group, self.arity, self.digits = list(group), arity, digits
        self.others = [c for c in rows.columns if c not in (*group, "h")]
        nodes = ranked(rows, group, order).select(*group, "rank", "n", F.struct("h", *self.others).alias("node"))
        self.tiers: list[DataFrame] = []
        while True:
            self.tiers.append(materialize(nested(nodes, self.group, arity, digits), "merkle-tier"))
            most = self.tiers[-1].agg(F.max("block").alias("b")).first()["b"]
            if not most:  # every group has one block (or there is none)
                break
            fewer = F.ceil(F.col("n") / arity ** digits).cast("long")
            nodes = self.tiers[-1].select(*group, F.col("block").alias("rank"), fewer.alias("n"),
                                          F.struct("node.h").alias("node"))

    def roots(self) -> DataFrame:
        """``(group, h)``, a row per group."""
        return self.tiers[-1].select(*self.group, "node.h")

    def proofs(self, above: DataFrame, context: Sequence[str] = ()) -> DataFrame:
        """``(group, others, h, path, context)`` of every row: ``path`` lists the digests left and right
        of the way up.  ``above`` has a row per group: ``(group, path, context)``."""
        carried = [*self.group, "block", "path", *context]
        ways = above.select(*self.group, F.lit(0).cast("long").alias("block"), "path", *context)
        for t in range(len(self.tiers) - 1, -1, -1):
            ways = self._down(t, ways, context)
            if t:
                ways = ways.select(*carried)
        return ways.select(*self.group, *self.others, "h", "path", *context)

    def _down(self, t: int, ways: DataFrame, context: Sequence[str]) -> DataFrame:
        blocks, keys = self.tiers[t], [*self.group, "block"]
        way = F.struct("path", *context)
        met = blocks.select(*keys, F.struct("n", "node").alias("tree"), F.lit(None).cast(
            ways.select(way.alias("w")).schema["w"].dataType).alias("way")).unionByName(
            ways.select(*keys, F.lit(None).cast(blocks.select(F.struct("n", "node").alias("x")).schema["x"].dataType).alias("tree"),
                        way.alias("way")))
        met = met.groupBy(*keys).agg(F.first("tree", ignorenulls=True).alias("tree"), F.first("way", ignorenulls=True).alias("way"))
        held = self.others if not t else []

        def leaf_of(k: Column, path: Column) -> Column:
            return F.struct(*[k[c].alias(c) for c in held], k.h.alias("h"), k.d.alias("d"), path.alias("path"))

        leaves = _handed_down(F.col("tree.node"), F.col("tree.n"), F.col("way.path"), self.arity, self.digits - 1, leaf_of)
        if t:  # the kids of a block of this tier are the blocks of the tier below, in rank order
            each = met.select(*self.group, "block", "way", F.posexplode(leaves).alias("_at", "l"))
            size = self.arity ** self.digits
            return each.select(*self.group, (F.col("block") * size + F.col("_at")).alias("block"), "l.path",
                               *[F.col("way")[c].alias(c) for c in context])
        return met.select(*self.group, "way", F.explode(leaves).alias("l")).select(
            *self.group, *[F.col("l")[c].alias(c) for c in held], "l.h", "l.path", *[F.col("way")[c].alias(c) for c in context])

    def forget(self) -> None:
        for t in self.tiers:
            forget(t)


def manifest(leaves: DataFrame, group: str, order: Sequence[str], arity: int = 2, digits: int = DIGITS) -> DataFrame:
    """``leaves`` (with the leaf digest in ``h``) and for each row ``path`` (from the leaf to the root:
    ``left`` and ``right`` siblings, concatenated), ``subroot`` (of its group) and ``root``.

    Groups are ordered by ``group``, NULL first, UTF-8 bytewise; so are rows within a group by
    ``order`` (NULL first), equal ones by their digest.  Rows equal in all of it are repeated leaves
    with neighbouring places.  A lone leaf is its subroot and a lone subroot the root, both with
    an empty path.  An empty table has no rows.  Texts are not read here, only digests, so their
    length does not matter.  Columns of ``leaves`` that are named ``path``, ``subroot`` or ``root``
    are replaced; ``rank``, ``n``, ``block`` and ``node`` are free to use."""
    own = [c for c in leaves.columns if c not in (group, "h", "path", "subroot", "root")]
    renamed = {c: f"_c{i}" for i, c in enumerate(own)}
    inner = leaves.select(F.col(f"`{group}`").alias("_group"), "h", *[F.col(f"`{c}`").alias(r) for c, r in renamed.items()])
    # equal rows of a hot key get a number of their own, so that ranges can part them
    inner = materialize(inner.withColumn("_copy", F.xxhash64(F.monotonically_increasing_id())), "merkle-leaves")
    trees = Tree(inner, ["_group"], [*[renamed[c] for c in order], "h", "_copy"], arity, digits)
    subroots = materialize(trees.roots(), "merkle-subroots")
    top = Tree(subroots.withColumn("_all", F.lit(0)), ["_all"], ["_group"], arity, digits)
    start = top.roots().select("_all", F.array().cast(_PATH).alias("path"), F.col("h").alias("root"))
    above = top.proofs(start, ["root"]).select("_group", "path", F.col("h").alias("subroot"), "root")
    found = trees.proofs(above, ["subroot", "root"])
    return found.select(F.col("_group").alias(group), *[F.col(r).alias(c) for c, r in renamed.items()],
                        "h", "path", "subroot", "root")


def proof_digest(path: Column) -> Column:
    """Digest of the siblings in turn, left to right, level by level."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s.left, s.right)), ""))


def folded(leaf_digest: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf_digest, lambda h, s: digest(F.concat(s.left, h, s.right)))
