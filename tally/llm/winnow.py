"""Document fingerprints by winnowing, in DataFrame functions only.

A text is cut into units: its words (split at ASCII white space); a run of more
than ``LONG_RUN`` characters without white space (CJK, Thai, a URL) counts as
its single characters.  A k-gram's hash is a polynomial over its units' hashes
and rolls: the next one takes the first unit off and the new one on.  Of every
window of ``window`` consecutive k-grams the smallest hash is selected, the
rightmost on ties, with its position.  Two texts that share
``k + window - 1`` consecutive units share at least one selected hash (the match
guarantee); matches shorter than ``k`` units are never seen.

Texts of fewer units than the guarantee's ``k + window - 1`` are winnowed by
their characters (without white space), and so are, besides their units, texts
shorter than as many of the longest words (``LONG_RUN`` characters each):
an edit that keeps a short text's length keeps its kind of grams.

A selected gram is one long: 31 bits of hash, then the complement of the
position, so that the smallest long is the smallest hash and, among equal
hashes, the one furthest to the right.  Positions of character grams begin at 2^31.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, text_or_empty

LOW = (1 << 32) - 1
PRIME = (1 << 31) - 1  # modulus of the rolling hash
BASE = 1_000_003
LONG_RUN = 16  # characters of a run without white space from beyond which it is cut
ROLLED = 32  # grams that one fold rolls through
OF_CHARACTERS = 1 << 31
_SPACE = r" \t\n\x0B\f\r"


def _hash(unit: Column) -> Column:
    return F.pmod(F.xxhash64(unit), F.lit(PRIME))


def unit_hashes(text: Column) -> Column:
    """The hashes of a text's units."""
    words = F.filter(F.split(text, f"[{_SPACE}]+"), lambda w: w != "")
    cut = F.flatten(F.transform(words, lambda w: F.when(
        F.length(w) > LONG_RUN, F.regexp_extract_all(w, F.lit("(?s)."), F.lit(0))).otherwise(F.array(w))))
    return F.transform(F.when(text.rlike(f"[^{_SPACE}]{{{LONG_RUN + 1}}}"), cut).otherwise(words), _hash)


def character_hashes(text: Column) -> Column:
    """The hashes of a text's characters that are no white space, others than those of one-letter words."""
    found = F.regexp_extract_all(text, F.lit(f"[^{_SPACE}]"), F.lit(0))
    return F.transform(found, lambda c: _hash(F.concat(F.lit("\x00"), c)))


def kgrams(hashes: Column, k: int, offset: int = 0) -> Column:
    """Packed k-grams ``(hash, complement of position)`` of an array of unit
    hashes; fewer than ``k`` units are one gram, none is no gram.  Positions count from ``offset``."""
    leaving = pow(BASE, k - 1, PRIME)

    def pack(h: Column, i: Column) -> Column:
        return F.shiftleft(h, 32).bitwiseOR(F.lit(LOW - offset) - i)

    def begun(h: Column, at: Column) -> Column:
        value = F.get(h, at)
        for j in range(1, k):
            value = (value * F.lit(BASE) + F.get(h, at + j)) % F.lit(PRIME)
        return value

    def rolled(h: Column, last: Column) -> Column:
        def run(at: Column) -> Column:
            end = F.least(at + (ROLLED - 1), last)
            rest = F.when(at < end, F.sequence(at + 1, end)).otherwise(F.array().cast("array<int>"))
            return F.aggregate(rest, F.array(begun(h, at)), lambda grams, i: F.array_append(
                grams, ((F.element_at(grams, -1) + F.lit(PRIME) - F.get(h, i - 1) * F.lit(leaving) % F.lit(PRIME)) * F.lit(BASE)
                        + F.get(h, i + (k - 1))) % F.lit(PRIME)))

        return F.flatten(F.transform(F.sequence(F.lit(0), last, F.lit(ROLLED)), run))

    def whole(h: Column) -> Column:
        return F.array(F.aggregate(h, F.lit(0).cast("long"), lambda a, x: (a * F.lit(BASE) + x) % F.lit(PRIME)))

    none = F.array().cast("array<bigint>")
    return let(hashes, lambda h: F.transform(
        F.when(F.size(h) == 0, none).when(F.size(h) < k, whole(h)).otherwise(rolled(h, F.size(h) - k)), pack))


def select(grams: Column, window: int) -> Column:
    """The winnowed grams, in order of position, each once."""
    def chosen(g: Column) -> Column:
        minima = F.transform(F.sequence(F.lit(0), F.size(g) - window),
                             lambda i: F.least(*[F.get(g, i + j) for j in range(window)]))
        return (F.when(F.size(g) == 0, g).when(F.size(g) < window, F.array(F.array_min(g)))
                .otherwise(F.array_distinct(minima)))

    return let(grams, chosen)


def with_fingerprint(df: DataFrame, text: str, out: str, k: int = 5, window: int = 4) -> DataFrame:
    """``df`` with the array of packed grams ``out``; NULL and blank texts have none."""
    own = text_or_empty(F.col(f"`{text}`"))
    enough = k + window - 1
    none = F.array().cast("array<bigint>")
    by_units = F.when(F.size("__h") >= enough, select(kgrams(F.col("__h"), k), window)).otherwise(none)
    short = (F.size("__h") < enough) | (F.length(own) < LONG_RUN * enough)
    by_characters = F.when(short, select(kgrams(character_hashes(own), k, OF_CHARACTERS), window)).otherwise(none)
    return (df.withColumn("__h", unit_hashes(own)).withColumn(out, F.concat(by_units, by_characters)).drop("__h"))


def unpack(fingerprint: Column) -> Column:
    """``array<struct<hash, position, of_characters>>`` (positions are k-gram numbers from 0)."""
    place = lambda x: F.lit(LOW) - x.bitwiseAND(F.lit(LOW))
    return F.transform(fingerprint, lambda x: F.struct(
        F.shiftright(x, 32).alias("hash"), (place(x) % OF_CHARACTERS).alias("position"),
        (place(x) >= OF_CHARACTERS).alias("of_characters")))


def as_string(fingerprint: Column) -> Column:
    """A digest of hashes and positions; equal fingerprints give equal strings."""
    return F.sha2(F.array_join(fingerprint.cast("array<string>"), ","), 256)


def hashes_of(fingerprint: Column) -> Column:
    return F.array_distinct(F.transform(fingerprint, lambda x: F.shiftright(x, 32)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two arrays of distinct hashes, 0 to 1; two empty ones are alike."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union == 0, F.lit(1.0)).otherwise(shared / union)


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, Window]:
    """``(doc_id, text, tie, bucket, ghost)`` laid out by descending doc_id, and the
    window over which ``lead`` is the next document.

    Buckets are ranges of doc_id.  The first document of every bucket is added
    to the bucket before it as a ghost row (the very first one to the last
    bucket), so each bucket is complete by itself and no window spans the
    table.  NULL ids come last; equal ids are ordered by a hash of the text.
    """
    spark = docs.sparkSession
    n = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_or_empty(F.col(f"`{text}`")).alias("text"))
    cuts = sorted(set(rows.select(F.col("doc_id").cast("double").alias("d")).approxQuantile(
        "d", [i / n for i in range(1, n)], 0.2 / n)))
    splits = [-float("inf"), *cuts, float("inf")]
    rows = rows.withColumns({"tie": F.xxhash64("text"), "__d": F.coalesce(F.col("doc_id").cast("double"), F.lit(-1e308))})
    rows = (Bucketizer(splits=splits, inputCol="__d", outputCol="bucket").transform(rows) if cuts
            else rows.withColumn("bucket", F.lit(0)))
    rows = rows.withColumn("bucket", F.col("bucket").cast("int")).drop("__d").withColumn("ghost", F.lit(0))
    key = F.struct(F.col("doc_id").isNotNull(), F.col("doc_id"), F.col("tie"))
    heads = rows.groupBy("bucket").agg(F.max_by(F.struct("doc_id", "text", "tie"), key).alias("r"))
    above = F.lead("bucket").over(Window.orderBy("bucket"))  # one row per bucket
    lowest = F.min("bucket").over(Window.orderBy("bucket"))
    ghosts = heads.select("r.doc_id", "r.text", "r.tie", F.coalesce(above, lowest).alias("bucket"), F.lit(1).alias("ghost"))
    laid = rows.unionByName(ghosts).repartition("bucket")
    order = Window.partitionBy("bucket").orderBy("ghost", F.desc_nulls_last("doc_id"), F.desc("tie"))
    return laid, order


def compare_edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5,
                   window: int = 4) -> DataFrame:
    """Fingerprints of every text and of its edited text (the last half of the
    code points replaced by as many of the next document in descending doc_id).

    ``doc_id, n_chars, edited_sha256, fp, edited_fp`` (packed grams),
    ``near_edited`` and ``near_next``.  NULL texts are empty; an empty table
    gives no rows; a single document is its own next; repeated rows stay.
    """
    laid, order = with_next(docs, doc_id, text)
    marked = with_fingerprint(laid, "text", "fp", k, window)
    nxt = marked.select(
        "doc_id", "text", "fp", "ghost", F.lead("text").over(order).alias("next"),
        F.lead("fp").over(order).alias("next_fp")).where("ghost = 0")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = nxt.withColumn("n_chars", n.cast("long")).withColumn(
        "edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next", F.lit(1), half)))
    both = with_fingerprint(edited.drop("text", "next"), "edited", "edited_fp", k, window)
    both = both.withColumn("own", hashes_of(F.col("fp")))
    return both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fp", "edited_fp",
        likeness(F.col("own"), hashes_of(F.col("edited_fp"))).alias("near_edited"),
        likeness(F.col("own"), hashes_of(F.col("next_fp"))).alias("near_next"))
