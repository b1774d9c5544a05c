"""Language identification by compression.

Every learned language has a dictionary of raw text.  A text is cut into blocks
(all of it, nothing is left out), each block is encoded with zstandard against
every dictionary, and the language whose encodings are smallest together wins.
The margin to the next one, relative to its size, says how sure that is; a
margin below ``min_margin`` is rejected.

The dictionaries are fitted on a bounded sample of the labelled rows: ``slots``
different texts per language, the one of the smallest hash in each of ``slots``
residues of the hash, and from each a piece of ``piece`` characters at a place
that the hash names.  That is a grouped minimum, so neither a hot language nor
a text with thousands of copies weighs more, and the sample does not depend on
the partitions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, materialize, with_python

#: The sample's bounds: texts per language, characters of each, and languages (more raise an error).
SLOTS, PIECE, MAX_LANGUAGES = 128, 512, 1000
#: Bytes of a block, and zstandard's level.
BLOCK, LEVEL = 4096, 6
#: Margins below this are rejected; it is the margin of score 0.5.
MIN_MARGIN = 0.02

UNDETERMINED = "und"
_LETTERS_ONLY = bytes(c if c > 127 or 97 <= c <= 122 else 32 for c in range(256))


def folded(text: str) -> bytes:
    """Lower case in UTF-8, every run of ASCII that is no letter as one blank."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_LETTERS_ONLY).split())


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


@dataclass
class Model:
    """Languages in the order that settles ties, and the raw content of their dictionaries."""

    languages: list[str]
    contents: list[bytes]
    level: int = LEVEL
    _encoders: list = field(default_factory=list, repr=False)

    def encoders(self) -> list[zstandard.ZstdCompressor]:
        if not self._encoders:
            for content in self.contents:
                d = zstandard.ZstdCompressionDict(content.ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=self.level)
                self._encoders.append(zstandard.ZstdCompressor(
                    level=self.level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        return self._encoders

    def __getstate__(self) -> dict:  # encoders are made anew in a worker
        return self.__dict__ | {"_encoders": []}

    def sizes(self, text: str, block: int = BLOCK) -> list[int]:
        """Encoded bytes of the whole text per language, without the frames' fixed bytes."""
        raw = folded(text)
        parts = [raw[i:i + block] for i in range(0, len(raw), block)]
        return [sum(len(e.compress(p)) for p in parts) - len(parts) * len(e.compress(b"")) for e in self.encoders()]

    def classify(self, text: str) -> tuple[str, float]:
        """The language of the smallest encoding (ties: the first) and its relative margin."""
        sizes = self.sizes(text)
        best = min(range(len(sizes)), key=sizes.__getitem__)
        others = sizes[:best] + sizes[best + 1:]
        return self.languages[best], (min(others) - sizes[best]) / max(min(others), 1) if others else 1.0


def fit(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", slots: int = SLOTS,
        piece: int = PIECE, max_languages: int = MAX_LANGUAGES) -> Model:
    """Dictionaries from the rows where ``learn`` is true, ``lang`` is not NULL and the text has a
    letter; at most ``slots * piece`` characters a language reach the driver.

    NULL and empty texts teach nothing, repeated rows count once, a very long text gives one piece
    like any other.  No such rows: a model without languages.  More than ``max_languages``
    languages raise an error, since every text is encoded with every dictionary."""
    t = F.col(f"`{text}`").cast("string")
    rows = docs.where(learn & F.col(f"`{lang}`").isNotNull() & has_letter(t)).select(
        F.col(f"`{lang}`").cast("string").alias("lang"), t.alias("text"), F.xxhash64(t).alias("h"))
    picked = materialize(rows.groupBy("lang", F.pmod("h", F.lit(slots)).alias("slot")).agg(F.min("h").alias("h")),
                         "lang-sample")
    n = picked.select("lang").distinct().count()
    if n > max_languages:
        raise ValueError(f"{n} languages, more than max_languages={max_languages}")
    begin = 1 + F.pmod(F.xxhash64("h"), F.greatest(F.length("text") - piece, F.lit(0)) + 1)
    chosen = rows.join(F.broadcast(picked), ["lang", "h"]).select(
        "lang", "h", F.substr("text", begin.cast("int"), F.lit(piece)).alias("piece"))
    found: dict[str, list[bytes]] = {}
    for r in chosen.groupBy("lang", "h").agg(F.min("piece").alias("piece")).orderBy("lang", "h").collect():
        found.setdefault(r["lang"], []).append(folded(r["piece"]))
    forget(picked)
    return Model(list(found), [b" ".join(p) for p in found.values()])


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None, text: str = "text",
             min_margin: float = MIN_MARGIN) -> DataFrame:
    """The columns ``keep`` (default: all) and, for every row,

    * ``lang_best``: the language of the smallest encoding, ``und`` for a text without a letter
      (NULL and empty ones too), and where the model has no languages;
    * ``lang_margin``: how much smaller it is than the next one, 0 to 1 (a single language: 1);
    * ``lang_score``: ``margin / (margin + min_margin)``, so 0.5 at the least margin that counts;
    * ``lang_pred``: ``lang_best``, or ``und`` where the margin is below ``min_margin``.

    Kept columns of these names are replaced.  A text is read whole, in blocks, however long.
    Ties take the first language by name with margin 0, which is rejected.  Repeated rows are
    judged alike; an empty table gives no rows."""
    own = ("lang_best", "lang_margin", "lang_score", "lang_pred")
    cols = [c for c in (docs.columns if keep is None else keep) if c not in own]
    t = F.col(f"`{text}`").cast("string")
    src = docs.select(*[F.col(f"`{c}`") for c in cols], F.when(has_letter(t), t).alias("__text"))
    schema = T.StructType([*src.schema[:-1], T.StructField("lang_best", T.StringType()),
                           T.StructField("lang_margin", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_LANGUAGES * SLOTS * PIECE characters
    at = len(cols)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            found = [m.classify(x.as_py()) if x.is_valid and m.languages else (UNDETERMINED, 0.0) for x in b.column(at)]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(at)), pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64())], names=schema.names)

    margin = F.col("lang_margin")
    return with_python(src).mapInArrow(judge, schema).select(
        "*", (margin / (margin + min_margin)).alias("lang_score"),
        F.when(margin >= min_margin, F.col("lang_best")).otherwise(UNDETERMINED).alias("lang_pred"))
