"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint per text; two fingerprints link when at most ``max_bits``
bits differ.  The 64 bits are cut into ``max_bits // 2 + 1`` segments, so that
in any linked pair one segment differs in at most one bit.  Every segment is
indexed once per bit with that bit deleted (a one-wildcard variant): two
segments that differ in at most one bit share the variant of that bit.  An
equality join on the variants finds all linked pairs, the Hamming distance
verifies them, connected components group them.

Copies collapse before the join: only distinct fingerprints are indexed.  A
variant that very many fingerprints share is split by the bits outside its
segment: in a linked pair at most ``max_bits`` of them differ, so of
``max_bits + 1`` pieces of these bits one is equal, and the join key gains that
piece.  Nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, text_or_empty, with_python
from .components import connected_components

HOT_VARIANT = 512  # from this many fingerprints on, a variant's join key gains a piece
SMALL_TABLE = 100_000  # rows of 16 bytes that may be broadcast


def text_fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """The unsigned fingerprint of one text: majority of the bits of the XXH64
    of its word shingles (A-Z lower-cased, ASCII white space splits)."""
    import xxhash

    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    if len(w) < words:
        shingles = iter([b" ".join(w)])
    else:
        shingles = map(b" ".join, zip(*(w[i:] for i in range(words))))
    n = max(1, len(w) - words + 1)
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), dtype="<u8", count=n)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 1 << 16):
        part = h[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def add_fingerprint(docs: DataFrame, text: str = "text", out: str = "fp",
                    words: int = 3, seed: int = 42, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) and the fingerprint as a signed
    64-bit integer.  A NULL or blank text has fingerprint 0."""
    cols = docs.columns if keep is None else keep
    src = docs.select(*[F.col(f"`{c}`") for c in cols], text_or_empty(F.col(f"`{text}`")).alias("__text"))
    schema = T.StructType([docs.schema[c] for c in cols] + [T.StructField(out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([text_fingerprint(t, words, seed) for t in b.column(len(cols)).to_pylist()],
                           dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(cols))] + [pa.array(fps)],
                                             names=[*cols, out])

    return with_python(src).mapInArrow(run, schema)


def _signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def _segments(max_bits: int) -> list[tuple[int, int]]:
    n = max_bits // 2 + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return list(zip(cuts, cuts[1:]))


def _pieces(max_bits: int) -> Column:
    """``(piece, value)`` for each of ``max_bits + 1`` equal pieces of the bits outside the segment of ``bit``."""
    out = F.lit(None)
    for lo, hi in _segments(max_bits):
        outside = [b for b in range(64) if not lo <= b < hi] or list(range(64))  # one segment: every bit
        cuts = [len(outside) * i // (max_bits + 1) for i in range(max_bits + 2)]
        masks = [sum(1 << b for b in outside[a:z]) for a, z in zip(cuts, cuts[1:])]
        split = F.array(*[F.struct(F.lit(i + 1).alias("piece"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("value"))
                          for i, m in enumerate(masks)])
        out = F.when(F.col("bit").between(lo, hi - 1), split).otherwise(out)
    return out


def _variants(fps: DataFrame, max_bits: int) -> DataFrame:
    """``(bit, rest, fp)``: the segment that holds ``bit`` without that bit."""
    own = F.lit(None).cast("long")
    for lo, hi in _segments(max_bits):
        mask = _signed(((1 << (hi - lo)) - 1) << lo)
        own = F.when(F.col("bit").between(lo, hi - 1), F.lit(mask).cast("long")).otherwise(own)
    bit = F.expr("shiftleft(1L, bit)")
    return (fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit"))
            .withColumn("own", own)
            .select("fp", "bit", F.col("fp").bitwiseAND(F.col("own")).bitwiseAND(F.bitwise_not(bit)).alias("rest")))


def links(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """All pairs ``(src, dst)`` of distinct fingerprints (column ``fp``, each
    once) that differ in 1 to ``max_bits`` bits, ``src < dst``."""
    if max_bits <= 0:
        return fps.sparkSession.createDataFrame([], "src long, dst long")
    v = _variants(fps, max_bits)
    sizes = v.groupBy("bit", "rest").count()
    hot = materialize(sizes.where(F.col("count") > HOT_VARIANT).select("bit", "rest"), "simhash-hot")
    n_hot = hot.count()
    keys = ["bit", "rest"]
    v = v.withColumn("piece", F.lit(0)).withColumn("value", F.lit(0).cast("long"))
    if n_hot:
        small = F.broadcast(hot) if n_hot <= SMALL_TABLE else hot
        busy = (v.drop("piece", "value").join(small, keys, "left_semi")
                .select("*", F.inline(_pieces(max_bits))))
        v = v.join(small, keys, "left_anti").unionByName(busy)
    keys += ["piece", "value"]
    a = v.select(*keys, F.col("fp").alias("src"))
    b = v.select(*keys, F.col("fp").alias("dst"))
    diff = F.bit_count(F.col("src").bitwiseXOR(F.col("dst")))
    # a table's size in the plan is that before the explode, by which Spark would broadcast all the variants
    return (a.join(b.hint("merge"), keys).where((F.col("src") < F.col("dst")) & (diff <= max_bits))
            .select("src", "dst").distinct())


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3,
               max_bits: int = 2, seed: int = 42) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs``.

    ``component_id`` is the smallest ``doc_id`` reachable over links, the row's
    own included; rows of equal fingerprints are linked.  Blank and NULL texts
    have fingerprint 0 and link like any other.  A NULL ``doc_id`` never is a
    component id unless all ids of the component are NULL.  Repeated rows stay.
    """
    rows = materialize(add_fingerprint(
        docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")),
        "text", "fp", words, seed, keep=["doc_id"]), "simhash")
    return rows.join(groups(rows, max_bits).select("fp", "component_id"), "fp").select(
        "doc_id", "fp", "component_id")


def groups(rows: DataFrame, max_bits: int = 2) -> DataFrame:
    """``(fp, component, component_id)`` per distinct fingerprint of ``rows``
    (``doc_id``, ``fp``): the component's label and its smallest doc_id."""
    reps = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-reps")
    comp = connected_components(links(reps.select("fp"), max_bits))
    labelled = reps.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "low", F.coalesce("component", "fp").alias("component"))
    low = labelled.groupBy("component").agg(F.min("low").alias("component_id"))
    return materialize(labelled.join(low, "component").select("fp", "component", "component_id"),
                       "simhash-groups")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3,
          max_bits: int = 2, seed: int = 42) -> DataFrame:
    """``docs`` with one row of every component: the one of the smallest
    doc_id (then of the smallest text hash).  All columns are kept as they are."""
    cols = [F.col(f"`{c}`") for c in docs.columns]
    tagged = add_fingerprint(docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(text_or_empty(F.col(f"`{text}`"))).alias("tie"),
        text_or_empty(F.col(f"`{text}`")).alias("text")), "text", "fp", words, seed, keep=["doc_id", "tie"])
    rows = materialize(tagged, "simhash-rows")
    member = groups(rows, max_bits).select("fp", "component")
    ranked = rows.join(member, "fp").withColumn(
        "rank", F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("tie")))
    best = (ranked.groupBy("component").agg(F.min("rank").alias("rank"))
            .select(F.col("rank.doc_id").alias("__id"), F.col("rank.tie").alias("__tie")))
    copies = rows.groupBy("doc_id", "tie").agg(F.count("*").alias("__n"))
    best = best.join(copies, F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__tie") == F.col("tie"))
                     ).select("__id", "__tie", "__n")
    best = materialize(best, "simhash-best")
    key = F.xxhash64(text_or_empty(docs[f"`{text}`"]))
    kept = docs.join(best, docs[f"`{doc_id}`"].eqNullSafe(best["__id"]) & (key == best["__tie"]))
    once = kept.where("__n = 1").select(*cols)
    if best.where("__n > 1").isEmpty():
        return once
    again = kept.where("__n > 1").dropDuplicates(["__id", "__tie"]).select(*cols)
    return once.union(again)
