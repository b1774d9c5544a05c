import hashlib
import re

import xxhash
from helpers import documents, odd_documents
from pyspark.sql import functions as F

from tally.llm import winnow

K, W = 5, 4


def units(text):
    words = [w for w in re.split("[ \t\n\x0b\x0c\r]+", text) if w]
    return [u for w in words for u in (w if len(w) > 16 else [w])]


def winnowed(parts, of_characters):
    """Winnowing gram by gram: every hash from the whole gram, every window looked through."""
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in parts]
    h = [(x - (1 << 64) if x >> 63 else x) % winnow.PRIME for x in h]
    grams = [h[i:i + K] for i in range(max(1, len(h) - K + 1))] if h else []
    g = [sum(x * pow(winnow.BASE, len(p) - 1 - j, winnow.PRIME) for j, x in enumerate(p)) % winnow.PRIME for p in grams]
    chosen = []
    for a in range(max(1, len(g) - W + 1) if g else 0):
        part = g[a:a + W]
        at = max(j for j, x in enumerate(part) if x == min(part)) + a
        if (g[at], at, of_characters) not in chosen:
            chosen.append((g[at], at, of_characters))
    return chosen


def brute(text):
    u = units(text)
    out = winnowed(u, False) if len(u) >= K + W - 1 else []
    if len(u) < K + W - 1 or len(text) < 16 * (K + W - 1):
        out += winnowed(["\0" + c for c in re.sub("[ \t\n\x0b\x0c\r]", "", text)], True)
    return out


def likeness(a, b):
    a, b = {x[0] for x in a}, {x[0] for x in b}
    return len(a & b) / len(a | b) if a | b else 1.0


TEXTS = ["a b c d e f g h i j k l", "x x x x x x x x x x x x x x", "one two three four five", "é ü\tñ\n\nß  a b c d", "", " \n", "a",
         "日本語の文章には空白がありませんから文字で数えます" * 4, "😀👍🏽" * 20, "word " * 33 + "y", " ".join(map(str, range(500))),
         "http://example.org/a/long/path/without/blanks and seven more words behind the address"]


def test_selection_matches_brute_force(spark):
    texts = TEXTS + [r["text"] for r in documents(spark).select("text").limit(40).collect()]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: [tuple(x) for x in r["f"]] for r in
           winnow.with_fingerprint(frame, "t", "p", K, W).select("i", winnow.unpack(F.col("p")).alias("f")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute(t), t


def test_half_kept_of_short_and_unspaced_texts(spark):
    rows = [(4, "日本語の文章には空白がありませんから文字で数えます。"), (3, "some seven words stand in this text"), (2, "ภาษาไทยเขียนติดกันโดยไม่มีช่องว่าง"),
            (1, "an English text of rather more words than the other ones have in them")]
    got = {r["doc_id"]: r for r in winnow.compare_edited(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(0.1 < r["near_edited"] < 1 and r["near_next"] < 0.1 for r in got.values())


def test_match_guarantee(spark):
    shared = " ".join(f"w{i}" for i in range(K + W - 1))
    rows = [(i, f"{'left ' * i}{shared}{' right' * (7 - i)}") for i in range(8)]
    frame = winnow.with_fingerprint(spark.createDataFrame(rows, "i int, t string"), "t", "p", K, W)
    sets = [set(r["h"]) for r in frame.select(winnow.hashes_of(F.col("p")).alias("h")).collect()]
    assert all(a & b for a in sets for b in sets)


def test_edited_texts_and_next_documents(spark):
    rows = [(10, "aé" * 7 + " x y z"), (5, "short"), (7, ""), (2, None), (30, "one two three four five six seven"), (29, "日本 " * 5)]
    rows += [(1000 + r["doc_id"], r["text"]) for r in documents(spark).select("doc_id", "text").collect()]
    got = {r["doc_id"]: r for r in winnow.compare_edited(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    ordered = sorted(rows, reverse=True)
    for i, (doc_id, t) in enumerate(ordered):
        t, nxt = t or "", ordered[(i + 1) % len(ordered)][1] or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + nxt[:half]
        r = got[doc_id]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_edited"] == likeness(brute(t), brute(edited)) and r["near_next"] == likeness(brute(t), brute(nxt))
        if edited == t:
            assert r["near_edited"] == 1.0 and r["fp"] == r["edited_fp"]


def test_odd_rows(spark):
    docs = odd_documents(spark)
    out = winnow.compare_edited(docs)
    assert out.count() == docs.count()
    assert winnow.compare_edited(docs.where("false")).count() == 0
    one = winnow.compare_edited(spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0
    many = spark.createDataFrame([(1, "same text here")] * 50, "doc_id long, text string")
    assert winnow.compare_edited(many).where("near_next = 1").count() == 50
