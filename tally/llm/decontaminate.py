"""Benchmark decontamination with an FM-index per training shard.

A shard is one Arrow batch of documents.  Its words become symbols (words that
no benchmark item uses are separators), the stream of symbols is indexed by a
suffix array, its Burrows-Wheeler transform goes into a wavelet matrix, and
every benchmark window is searched backwards through wavelet ranks.  The
occurrences are located by stepping to the next sampled suffix position; their
word positions merge into removal spans per document.

Exact pruning before the index is built: a window can only occur inside a run
of benchmark words at least as long as the shortest window, so shorter runs
are left out of the stream.  The benchmark is sent to the tasks in blocks of a
bounded size, one pass over the documents per block; spans and items of
earlier blocks are merged, so a benchmark of any size gives the same result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, materialize, text_or_empty, with_python

BLOCK_CHARS = 16_000_000  # benchmark text per pass, so the broadcast stays under about 200 MB
SAMPLE = 8  # every 8th text position keeps its suffix position

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32
               for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str) -> list[bytes]:
    """Runs of 0-9, a-z and non-ASCII characters after lower-casing A-Z."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split()


class WaveletMatrix:
    """Rank over a sequence of non-negative integers, many queries at once."""

    def __init__(self, seq: np.ndarray) -> None:
        self.n = len(seq)
        self.levels = max(1, int(seq.max(initial=0)).bit_length())
        self.words, self.before, self.zeros = [], [], []
        cur = seq
        for level in range(self.levels - 1, -1, -1):
            bits = ((cur >> level) & 1).astype(bool)
            padded = np.zeros((self.n // 64 + 1) * 64, dtype=bool)
            padded[:self.n] = bits
            packed = np.packbits(padded, bitorder="little").view("<u8")
            ones = np.bitwise_count(packed).astype(np.int64)
            self.words.append(packed)
            self.before.append(np.concatenate([[0], np.cumsum(ones)[:-1]]))
            self.zeros.append(int(self.n - bits.sum()))
            cur = np.concatenate([cur[~bits], cur[bits]])

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        block = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[level][block] + np.bitwise_count(self.words[level][block] & mask).astype(np.int64)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before position ``i``."""
        lo = np.zeros_like(i)
        for level in range(self.levels):
            one = ((symbol >> (self.levels - 1 - level)) & 1).astype(bool)
            a, b = self._ones(level, lo), self._ones(level, i)
            lo = np.where(one, self.zeros[level] + a, lo - a)
            i = np.where(one, self.zeros[level] + b, i - b)
        return i - lo

    def symbol_and_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at ``i`` and how often it stands before ``i``."""
        lo, symbol = np.zeros_like(i), np.zeros_like(i)
        for level in range(self.levels):
            a, b = self._ones(level, lo), self._ones(level, i)
            one = (self._ones(level, i + 1) - b).astype(bool)
            symbol = symbol * 2 + one
            lo = np.where(one, self.zeros[level] + a, lo - a)
            i = np.where(one, self.zeros[level] + b, i - b)
        return symbol, i - lo


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling; the sequence must end in a unique smallest symbol."""
    n = len(seq)
    sa = np.argsort(seq, kind="stable")
    ordered = seq[sa]
    rank = np.empty(n, dtype=np.int64)
    rank[sa] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
    step = 1
    while step < n and int(rank[sa[-1]]) < n - 1:
        after = np.zeros(n, dtype=np.int64)
        after[:-step] = rank[step:] + 1
        key = rank * (n + 1) + after
        sa = np.argsort(key, kind="stable")
        ordered = key[sa]
        rank[sa] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        step *= 2
    return sa


class FMIndex:
    """FM-index of a symbol stream (symbols from 1 on; 0 ends the stream)."""

    def __init__(self, stream: np.ndarray) -> None:
        seq = np.concatenate([stream, [0]]).astype(np.int64)
        sa = suffix_array(seq)
        self.n = len(seq)
        self.bwt = WaveletMatrix(seq[sa - 1])
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq))])  # rows before each symbol's
        sampled = sa % SAMPLE == 0
        self.sampled = WaveletMatrix(sampled.astype(np.int64))
        self.is_sampled = sampled
        self.positions = sa[sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges ``[lo, hi)`` of padded phrases (rows of symbols), by backward search."""
        lo = np.zeros(len(phrases), dtype=np.int64)
        hi = np.full(len(phrases), self.n, dtype=np.int64)
        live = np.arange(len(phrases))
        for back in range(1, int(lengths.max(initial=0)) + 1):
            here = live[(lengths[live] >= back)]
            if not len(here):
                break
            symbol = phrases[here, lengths[here] - back]
            known = symbol < len(self.first) - 1
            safe = np.where(known, symbol, 0)
            lo[here] = np.where(known, self.first[safe] + self.bwt.rank(safe, lo[here]), 0)
            hi[here] = np.where(known, self.first[safe] + self.bwt.rank(safe, hi[here]), 0)
            live = live[lo[live] < hi[live]]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Stream positions of suffix rows: walk back to the next sampled one."""
        at, steps, out = rows.copy(), np.zeros_like(rows), np.empty_like(rows)
        open_ = np.arange(len(rows))
        while len(open_):
            done = self.is_sampled[at[open_]]
            hit = open_[done]
            ones = self.sampled.rank(np.ones(len(hit), dtype=np.int64), at[hit])
            out[hit] = self.positions[ones] + steps[hit]
            open_ = open_[~done]
            symbol, rank = self.bwt.symbol_and_rank(at[open_])
            at[open_] = self.first[symbol] + rank
            steps[open_] += 1
        return out


class Phrases:
    """The distinct windows of one benchmark block and the items they come from."""

    def __init__(self, items: list[tuple[str, str]], window: int) -> None:
        vocab: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set[str | None]] = {}
        for item_id, text in items:
            ids = [vocab.setdefault(w, len(vocab) + 2) for w in words_of(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                windows.setdefault(tuple(ids[i:i + window]), set()).add(item_id)
        self.vocab = vocab
        self.lengths = np.array([len(w) for w in windows], dtype=np.int64)
        self.symbols = np.zeros((len(windows), window), dtype=np.int64)
        for i, w in enumerate(windows):
            self.symbols[i, :len(w)] = w
        self.items = [sorted(x for x in s if x is not None) for s in windows.values()]


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def search_shard(texts: list[str], phrases: Phrases) -> tuple[np.ndarray, np.ndarray, list[set[str]]]:
    """Word counts, word-level hit flags of the whole shard and items per text."""
    parts, counts = [], np.zeros(len(texts), dtype=np.int64)
    known = phrases.vocab.get
    for i, t in enumerate(texts):
        w = words_of(t)
        counts[i] = len(w)
        parts.append(np.fromiter((known(x, 0) for x in w), dtype=np.int64, count=len(w)))
        parts.append(np.zeros(1, dtype=np.int64))
    whole = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(counts + 1)])
    hit = np.zeros(len(whole) + 1, dtype=np.int64)
    items: list[set[str]] = [set() for _ in texts]
    starts, ends = _runs(whole > 0)
    if len(phrases.lengths):
        keep = ends - starts >= phrases.lengths.min()
        starts, ends = starts[keep], ends[keep]
    if len(phrases.lengths) and len(starts):
        # the kept runs, each followed by the separator 1, and where their words stand
        size = ends - starts + 1
        origin = np.arange(size.sum()) + np.repeat(starts - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        stream = whole[np.minimum(origin, len(whole) - 1)]
        stream[np.cumsum(size) - 1] = 1
        index = FMIndex(stream)
        lo, hi = index.search(phrases.symbols, phrases.lengths)
        found = np.flatnonzero(lo < hi)
        n = hi[found] - lo[found]
        rows = np.arange(n.sum()) + np.repeat(lo[found] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        window = np.repeat(found, n)
        at = origin[index.locate(rows)]
        np.add.at(hit, at, 1)
        np.add.at(hit, at + phrases.lengths[window], -1)
        doc = np.searchsorted(offsets, at, side="right") - 1
        pairs = np.unique(doc * len(phrases.lengths) + window)
        for d, w in zip((pairs // len(phrases.lengths)).tolist(), (pairs % len(phrases.lengths)).tolist()):
            items[d].update(phrases.items[w])
    flags = np.cumsum(hit)[:len(whole)] > 0
    return counts, flags, items


def benchmark_blocks(benchmark: DataFrame, window: int, item_id: str, text: str) -> tuple[int, Callable[[int], Phrases]]:
    """How many blocks of about ``BLOCK_CHARS`` characters the benchmark has (an item is never cut), and
    what gives the windows of one: the driver holds one block at a time."""
    rows = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("i"),
                            text_or_empty(F.col(f"`{text}`")).alias("t")).distinct()
    chars = rows.agg(F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("n")).first()["n"]
    blocks = 1 + chars // BLOCK_CHARS

    def block(k: int) -> Phrases:
        part = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k)
        return Phrases([(r["i"], r["t"]) for r in part.collect()], window)

    return blocks, block


def _merge(flags: np.ndarray, spans: tuple[list[int], list[int]]) -> np.ndarray:
    for a, b in zip(*spans):
        flags[a:b] = True
    return flags


def find_spans(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text",
               item_id: str = "item_id", item_text: str = "text",
               keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) with ``n_words``, the merged
    removal spans as word positions ``hit_start`` / ``hit_end`` (half-open
    arrays) and the sorted ``items`` whose windows occur.

    A window is ``window`` consecutive words of an item; an item of fewer words
    is one window; an item without words none.  NULL and empty texts have no
    words, no spans and no items.  Items with a NULL id mark hits but are not
    listed; repeated items count once.  No benchmark rows: no hits; no documents:
    no rows.  Texts are searched whole, however long, and rows one by one, so repeated ones
    are alike.  Kept columns of the four names are replaced.

    A benchmark beyond one block is searched block by block; between two blocks
    the rows are written and the block's broadcast is destroyed.
    """
    cols = [c for c in (docs.columns if keep is None else keep) if c not in ("n_words", "hit_start", "hit_end", "items")]
    frame = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)],
                        text_or_empty(F.col(f"`{text}`")).alias("__text"))
    own = frame.schema.fields[:len(cols)]
    found = [T.StructField("n_words", T.LongType()), T.StructField("hit_start", T.ArrayType(T.IntegerType())),
             T.StructField("hit_end", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.StringType()))]
    text_field = T.StructField("__text", T.StringType())
    sc = docs.sparkSession.sparkContext
    blocks, block = benchmark_blocks(benchmark, window, item_id, item_text)
    frame = with_python(frame)
    for k in range(blocks):
        phrases, last = sc.broadcast(block(k)), k == blocks - 1

        def run(batches: Iterator[pa.RecordBatch], phrases=phrases, first=k == 0, last=last):
            for b in batches:
                texts = b.column(len(own)).to_pylist()
                counts, flags, items = search_shard(texts, phrases.value)
                starts, ends, listed, at = [], [], [], 0
                for i in range(len(texts)):
                    mine = flags[at:at + counts[i]]
                    at += counts[i] + 1
                    if not first:
                        mine = _merge(mine, (b.column(len(own) + 2)[i].as_py(), b.column(len(own) + 3)[i].as_py()))
                        items[i].update(b.column(len(own) + 4)[i].as_py())
                    s, e = _runs(mine) if mine.any() else ((), ())
                    starts.append(s)
                    ends.append(e)
                    listed.append(sorted(items[i]))
                arrays = [b.column(i) for i in range(len(own) + (0 if last else 1))]
                yield pa.RecordBatch.from_arrays(
                    arrays + [pa.array(counts), pa.array(starts, pa.list_(pa.int32())),
                              pa.array(ends, pa.list_(pa.int32())), pa.array(listed, pa.list_(pa.string()))],
                    names=[f.name for f in own] + ([] if last else ["__text"]) + [f.name for f in found])

        schema = T.StructType([*own, *([] if last else [text_field]), *found])
        before, frame = frame, frame.mapInArrow(run, schema)
        if blocks > 1:
            frame = materialize(frame, "benchmark-pass")
            phrases.destroy()
            if k:
                forget(before)
    return frame.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(cols)],
                        "n_words", "hit_start", "hit_end", "items")


def cut_spans(text: str, starts: list[int], ends: list[int]) -> str:
    """``text`` without the words of the spans and what stands between them;
    one line break marks each cut."""
    places = [m.span() for m in _WORD.finditer(re.sub("[A-Z]", lambda m: m[0].lower(), text))]
    out, at = [], 0
    for s, e in zip(starts, ends):
        out.append(text[at:places[s][0]].rstrip())
        at = places[e - 1][1]
    out.append(text[at:].lstrip())
    return "\n".join(x for x in out if x)


def _replaced(b: pa.RecordBatch, at: int, counted: int | None, texts: list, changed: set[int]) -> pa.RecordBatch:
    """The batch with the changed texts and their lengths, without the rows of which nothing is left."""
    if not changed:
        return b
    arrays = list(b.columns)
    arrays[at] = pa.array(texts, arrays[at].type)
    if counted is not None:
        n = b.column(counted).to_pylist()
        for i in changed:
            n[i] = len(texts[i])
        arrays[counted] = pa.array(n, arrays[counted].type)
    b = pa.RecordBatch.from_arrays(arrays, names=b.schema.names)
    return b.filter(pa.array([i not in changed or bool(texts[i].strip()) for i in range(len(texts))]))


def _cut_in_rounds(frame: DataFrame, benchmark: DataFrame, window: int, at: int, counted: int | None) -> DataFrame:
    """Every round finds the spans of all blocks and cuts them at once; the rows it changed are
    searched again."""
    n, schema, done, live = len(frame.columns), frame.schema, None, frame

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, starts, ends = (b.column(i).to_pylist() for i in (at, n + 1, n + 2))
            changed = {i for i, s in enumerate(starts) if s}
            for i in changed:
                texts[i] = cut_spans(texts[i], starts[i], ends[i])
            marked = pa.RecordBatch.from_arrays([*b.columns[:n], pa.array([i in changed for i in range(len(texts))], pa.bool_())],
                                                names=[*schema.names, "__cut"])
            yield _replaced(marked, at, counted, texts, changed)

    while True:
        found = find_spans(live, benchmark, window, schema.names[at])
        cuts = materialize(with_python(found).mapInArrow(cut, T.StructType([*schema.fields, T.StructField("__cut", T.BooleanType())])),
                           "benchmark-cut")
        left = cuts.where(~F.col("__cut")).drop("__cut")
        done, live = (left if done is None else done.unionByName(left)), cuts.where("__cut").drop("__cut")
        if not live.take(1):
            return done


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text",
                  n_chars: str | None = None) -> DataFrame:
    """``docs`` with every benchmark occurrence cut out of its text.

    A cut can bring two halves of a window together, so changed texts are
    searched again until nothing is found.  A document of which nothing is
    left goes; documents without a hit, empty and NULL texts included, stay as
    they are, however long, and repeated ones alike.  ``n_chars`` names a column that gets
    the new length.  All other columns are kept.  No documents: no rows.

    Where windows overlap across blocks the order of cuts decides which is cut first, so a
    benchmark beyond one block is first searched whole: every round finds the spans of all
    blocks, then cuts them at once, until a round finds none.  That is what one block does.
    """
    cols = docs.columns
    at = cols.index(text)
    counted = cols.index(n_chars) if n_chars in cols else None
    frame = with_python(docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)]))
    blocks, block = benchmark_blocks(benchmark, window, "item_id", "text")
    if blocks > 1:
        frame = _cut_in_rounds(frame, benchmark, window, at, counted)
    else:
        phrases = docs.sparkSession.sparkContext.broadcast(block(0))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = b.column(at).to_pylist()
                live = [i for i, t in enumerate(texts) if t]
                changed: set[int] = set()
                while live:
                    counts, flags, _ = search_shard([texts[i] for i in live], phrases.value)
                    pos, again = 0, []
                    for i, n in zip(live, counts.tolist()):
                        mine = flags[pos:pos + n]
                        pos += n + 1
                        if mine.any():
                            s, e = _runs(mine)
                            texts[i] = cut_spans(texts[i], s.tolist(), e.tolist())
                            again.append(i)
                    changed.update(again)
                    live = [i for i in again if texts[i]]
                yield _replaced(b, at, counted, texts, changed)

        frame = frame.mapInArrow(run, frame.schema)
    return frame.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(cols)])
