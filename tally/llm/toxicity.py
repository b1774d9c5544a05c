"""Toxicity by a weighted lexicon.

Texts are folded first: lower case, homoglyphs and accented letters to their
base letter, digits and signs that stand for letters inside a word, invisible
characters away.  Lexicon entries (whole words and word beginnings, each with a
log-odds weight) are found by an Aho-Corasick automaton; of the entries that
match at a word's start the heaviest counts.  A match inside an exception
phrase (a two-word phrase that clean texts use) does not count.  The weights
are summed, normalised by the text's length, and a logistic model turns the
features into a score.

Lexicon, exceptions and model are learned from labelled texts (a bounded
sample, ``MAX_LABELLED``); the labels' ids are broadcast, so no text is
shuffled.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_or_empty, with_python

MAX_LABELLED = 200_000  # labelled rows that the lexicon and the model are fitted on
MAX_LEXICON = 20_000  # entries kept, the heaviest first
CACHED = 150_000  # words whose folding or matches a worker remembers
PREFIX = range(4, 9)  # lengths of word beginnings that may become entries
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "l"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
#: letters of other scripts that look like a Latin letter
LOOKALIKES = {
    "a": "аα", "b": "вβ", "c": "сϲ", "d": "ԁ", "e": "еε", "g": "ɡ", "h": "һ",
    "i": "іιıӏ", "j": "ј", "k": "кκ", "l": "ⅼ", "m": "м", "n": "η", "o": "оοօ",
    "p": "рρ", "q": "ԛ", "s": "ѕ", "t": "тτ", "u": "υս", "v": "νѵ", "w": "ԝω", "x": "хχ",
    "y": "уγ", "z": "ᴢ",
}


def _fold_table() -> dict[int, str]:
    table = {ord(x): base for base, xs in LOOKALIKES.items() for x in xs}
    for block in (range(0xC0, 0x250), range(0x1E00, 0x1F00), range(0x2100, 0x2190), range(0x24B6, 0x24EA),
                  range(0xFF21, 0xFF5B), range(0x1D400, 0x1D800)):
        for c in block:
            base = unicodedata.normalize("NFKD", chr(c))[:1].lower()
            if base.isascii() and base.isalnum() and c not in table:
                table[c] = base
    for c in (0xAD, *range(0x200B, 0x2010), 0x2060, 0xFEFF, *range(0x300, 0x370)):
        table[c] = ""
    return table


_FOLD = _fold_table()
_LEET = str.maketrans(DIGITS | SIGNS)
_DISGUISED = re.compile(r"[^\W_]*(?:[0-9]|[@$](?=[^\W_])|(?<=[^\W\d_])[!|](?=[^\W_]))[^\W_]*(?:(?:[@$!|](?=[^\W_]))[^\W_]*)*")
_SPECIAL = re.compile("[0-9@$!|]")
_WORD = re.compile(r"[^\W_]+")


def _undisguise(m: re.Match) -> str:
    s = m[0]
    return s.translate(_LEET) if any(c.isalpha() for c in s) else s


def _fold_token(token: str) -> tuple[str, ...]:
    s = token.lower()
    if not s.isascii():
        s = s.translate(_FOLD)
    if s.isalpha():
        return (s,)
    if _SPECIAL.search(s):
        s = _DISGUISED.sub(_undisguise, s)
    return tuple(_WORD.findall(s))


#: token -> folded words; folding looks at one token at a time, and tokens repeat
_FOLDED: dict[str, tuple[str, ...]] = {}


def fold(text: str) -> list[str]:
    """The folded words of a text."""
    tokens = text.split()
    if len(_FOLDED) > CACHED:
        _FOLDED.clear()
    for t in set(tokens).difference(_FOLDED):
        _FOLDED[t] = _fold_token(t)
    return list(chain.from_iterable(map(_FOLDED.__getitem__, tokens)))


def _terms(word: str) -> tuple[str, ...]:
    """Possible lexicon entries: ``word `` (whole) and word beginnings."""
    return (word + " ", *(word[:k] for k in PREFIX if len(word) > k))


def _all_terms(words: list[str]) -> set[str]:
    return set(chain.from_iterable(map(_terms, set(words))))


class _KnownTerms:
    """A text's terms among ``known``; what a word gives is remembered."""

    def __init__(self, known: frozenset[str]) -> None:
        self.known = known
        self.of: dict[str, tuple[str, ...]] = {}

    def __call__(self, words: list[str]) -> set[str]:
        distinct = set(words)
        if len(self.of) > CACHED:
            self.of.clear()
        for w in distinct.difference(self.of):
            self.of[w] = tuple(t for t in _terms(w) if t in self.known)
        return set(chain.from_iterable(map(self.of.__getitem__, distinct)))


@dataclass
class Lexicon:
    """Entry -> weight; an entry that ends in a space is a whole word."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for entry, w in self.weights.items():
            a.add_word(" " + entry, (len(entry), w))
        if self.weights:
            a.make_automaton()
        return a

    def hits(self, words: list[str], automaton) -> dict[str, float]:
        """The matching words and their weights: the automaton reads all words, each preceded and
        followed by a space; entries begin at a word's start, the heaviest counts."""
        if not self.weights or not words:
            return {}
        line = " " + " ".join(words) + " "
        best: dict[int, float] = {}
        for end, (size, w) in automaton.iter(line):
            start = end - size + 1
            best[start] = max(w, best.get(start, -math.inf))
        return {line[start:line.index(" ", start)]: w for start, w in best.items()}


class Matcher:
    """Matches of texts; the automaton reads every distinct word once (a match lies in one word)."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon, self.automaton = lexicon, lexicon.automaton()
        self.seen: set[str] = set()
        self.weight: dict[str, float] = {}
        self.clean: dict[str, bool] = {}  # token -> whether it holds no match

    def _read(self, words: set[str]) -> None:
        if len(self.seen) > CACHED:
            self.seen, self.weight = set(), {}
        new = words - self.seen
        if new:
            self.weight.update(self.lexicon.hits(list(new), self.automaton))
            self.seen |= new

    def matches(self, words: list[str]) -> list[tuple[str, str, str, float]]:
        """``(previous word, word, next word, weight)`` of every matching word."""
        distinct = set(words)
        self._read(distinct)
        if distinct.isdisjoint(self.weight):
            return []
        last = len(words) - 1
        return [(words[i - 1] if i else "", w, words[i + 1] if i < last else "", self.weight[w])
                for i, w in enumerate(words) if w in self.weight]

    def features(self, words: list[str]) -> tuple[float, float, float]:
        """Summed weight (damped), summed weight per length, heaviest weight; matches inside an
        exception phrase aside."""
        total = top = 0.0
        exceptions = self.lexicon.exceptions
        for left, word, right, w in self.matches(words):
            if f"{left} {word}" in exceptions or f"{word} {right}" in exceptions:
                continue
            total += w
            top = max(top, w)
        return math.log1p(total), min(1.0, total / (len(words) + 10)), top

    def features_of(self, text: str) -> tuple[float, float, float]:
        """The features of a text; one whose tokens are known to hold no match needs no words."""
        tokens = text.split()
        if None in map(self.clean.get, tokens):
            if len(self.clean) > CACHED:
                self.clean.clear()
            new = {t: _fold_token(t) for t in set(tokens).difference(self.clean)}
            self._read(set(chain.from_iterable(new.values())))
            self.clean.update((t, self.weight.keys().isdisjoint(words)) for t, words in new.items())
        if all(map(self.clean.__getitem__, tokens)):
            return 0.0, 0.0, 0.0
        return self.features(fold(text))

    def phrases(self, words: list[str]) -> set[str]:
        """The two-word phrases around matches."""
        return {p for left, word, right, _ in self.matches(words) for p in (f"{left} {word}", f"{word} {right}")}


def _counted(frame: DataFrame, make) -> DataFrame:
    """``(term, toxic, n)`` from ``(text, toxic)``: ``pick(words)`` per text (``make`` gives a task its
    ``pick``), summed per task, then overall."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pick = make()
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def taken() -> pa.RecordBatch:
            rows = [(t, k, n) for k in (0, 1) for t, n in counts[k].items()]
            for c in counts:
                c.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()),
                 pa.array([r[2] for r in rows], pa.int64())], names=["term", "toxic", "n"])

        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                counts[toxic].update(pick(fold(text)))
                if len(counts[toxic]) > CACHED:
                    yield taken()
        yield taken()

    return (with_python(frame).mapInArrow(run, "term string, toxic int, n long")
            .groupBy("term", "toxic").agg(F.sum("n").alias("n")))


def _weight(a: float, n_toxic: int, c: float, n_clean: int) -> float:
    return math.log((a + 0.5) / (n_toxic + 1) / ((c + 0.5) / (n_clean + 1)))


def _evidence(a: int, n_toxic: int, c: int, n_clean: int) -> float:
    """Twice the log-likelihood ratio of an entry's split over the classes against chance."""
    p = n_toxic / (n_toxic + n_clean)
    q = a / (a + c)
    return 2 * (a * math.log(q / p) + (c * math.log((1 - q) / (1 - p)) if c else 0.0))


def learn_lexicon(train: DataFrame) -> Lexicon:
    """A lexicon from ``(text, toxic)`` rows (no NULLs).

    Entries occur in enough toxic texts (at least 3, and 0.2 %), at least five
    times likelier than in clean ones, and more clearly so than chance makes the
    best of as many candidates; a longer entry is left out where its own
    beginning weighs about as much.
    """
    sizes = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return Lexicon()
    support = max(3, math.ceil(0.002 * n_toxic))
    frequent = _counted(train.where("toxic = 1"), lambda: _all_terms).where(F.col("n") >= support)
    in_toxic = {r["term"]: r["n"] for r in frequent.orderBy(F.desc("n"), "term").limit(50 * MAX_LEXICON).collect()}
    known = train.sparkSession.sparkContext.broadcast(frozenset(in_toxic))
    clean = _counted(train.where("toxic = 0"), lambda: _KnownTerms(known.value))
    in_clean = {r["term"]: r["n"] for r in clean.collect()}
    chance = 2 * math.log(len(in_toxic) + 1) + 2
    weights = {t: _weight(a, n_toxic, in_clean.get(t, 0), n_clean) for t, a in in_toxic.items()
               if _evidence(a, n_toxic, in_clean.get(t, 0), n_clean) > chance}
    kept: dict[str, float] = {}
    for t in sorted(weights, key=lambda t: (len(t), t)):
        w = weights[t]
        shorter = max((kept.get(t[:k], -math.inf) for k in PREFIX if k < len(t)), default=-math.inf)
        if w >= math.log(5) and shorter < w - 0.7:
            kept[t] = w
    heaviest = sorted(kept, key=lambda t: (-kept[t] * math.sqrt(in_toxic[t]), t))[:MAX_LEXICON]
    lexicon = Lexicon({t: kept[t] for t in heaviest})
    used: dict[str, list[int]] = {}
    for r in (_counted(train, lambda: Matcher(lexicon).phrases).groupBy("term").agg(
            F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c"),
            F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"))
            .where("c >= 3").orderBy(F.desc("c"), "term").limit(MAX_LEXICON).collect()):
        used[r["term"]] = [r["c"], r["a"]]
    lexicon.exceptions = frozenset(
        p for p, (c, a) in used.items() if " " in p.strip() and _weight(a, n_toxic, c, n_clean) < 0)
    return lexicon


def add_features(docs: DataFrame, lexicon: Lexicon, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` with ``__f0``, ``__f1``, ``__f2``."""
    src = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)],
                      text_or_empty(F.col(f"`{text}`")).alias("__text"))
    n, names = len(keep), [f"c{i}" for i in range(len(keep))]
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value)
        for b in batches:
            rows = [matcher.features_of(t) for t in b.column(n).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:n], *(pa.array([r[i] for r in rows], pa.float64()) for i in range(3))],
                names=[*names, "__f0", "__f1", "__f2"])

    schema = src.drop("__text").schema
    for i in range(3):
        schema = schema.add(f"__f{i}", "double")
    return (with_python(src).mapInArrow(run, schema)
            .select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "__f0", "__f1", "__f2"))


@dataclass
class Model:
    lexicon: Lexicon
    intercept: float
    slopes: tuple[float, float, float]

    def score(self) -> Column:
        z = F.lit(self.intercept)
        for i, s in enumerate(self.slopes):
            z = z + F.lit(s) * F.col(f"__f{i}")
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def bounded_labels(labels: DataFrame, doc_id: str = "doc_id", toxic: str = "toxic",
                   train: Column | None = None) -> DataFrame:
    """``(__id, toxic)`` of at most about ``MAX_LABELLED`` labelled rows, chosen by a hash of the id;
    contradicting labels of one id count as toxic, NULLs are no labels."""
    rows = labels if train is None else labels.where(train)
    rows = (rows.where(F.col(doc_id).isNotNull() & F.col(toxic).isNotNull())
            .groupBy(F.col(doc_id).alias("__id")).agg(F.max((F.col(toxic) != 0).cast("int")).alias("toxic")))
    n = rows.count()
    if n > MAX_LABELLED:
        share = int(MAX_LABELLED / n * (1 << 30))
        rows = rows.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) < share)
    return rows


def fit(docs: DataFrame, labels: DataFrame, train: Column | None = None, doc_id: str = "doc_id",
        text: str = "text", toxic: str = "toxic") -> Model:
    """Learn lexicon, exceptions and logistic model from the labelled texts.

    ``train`` selects rows of ``labels``.  Without both classes among them the
    score is the smoothed share of toxic labels (0.5 without any label).
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    chosen = F.broadcast(bounded_labels(labels, doc_id, toxic, train))
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_or_empty(F.col(f"`{text}`")).alias("text"))
    train_rows = rows.join(chosen, F.col("doc_id") == F.col("__id")).select("text", "toxic")
    lexicon = learn_lexicon(train_rows)
    feats = materialize(add_features(train_rows, lexicon, ["toxic"]), "toxicity-train")
    sizes = {r["toxic"]: r["n"] for r in feats.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    a, c = sizes.get(1, 0), sizes.get(0, 0)
    if not a or not c or not lexicon.weights:
        return Model(lexicon, math.log((a + 0.5) / (c + 0.5)), (0.0, 0.0, 0.0))
    vectors = VectorAssembler(inputCols=["__f0", "__f1", "__f2"], outputCol="x").transform(feats)
    lr = LogisticRegression(featuresCol="x", labelCol="toxic", regParam=1e-4, maxIter=100).fit(
        vectors.select("x", F.col("toxic").cast("double").alias("toxic")))
    return Model(lexicon, float(lr.intercept), tuple(float(v) for v in lr.coefficients))


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, text: str = "text",
          out: str = "score") -> DataFrame:
    """The columns ``keep`` (all by default) with a score from 0 to 1.  NULL and
    empty texts score as a text without matches; repeated rows score alike; an empty
    table gives no rows.  A kept column named as ``out`` is replaced."""
    cols = [c for c in (docs.columns if keep is None else keep) if c != out]
    scored = add_features(docs, model.lexicon, cols, text)
    return scored.withColumn("__score", model.score()).select(
        *[F.col(f"`{c}`") for c in cols], F.col("__score").alias(out))


def reject(docs: DataFrame, model: Model, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; columns as they are."""
    scored = score(docs, model, None, text, "__toxicity")
    return scored.where(F.col("__toxicity") < threshold).drop("__toxicity")
