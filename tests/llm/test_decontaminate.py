import numpy as np
import pytest
from helpers import SF, documents, odd_documents

from tally.llm import decontaminate as dc


def brute(docs, items, window=10):
    """doc position -> (words, hit word positions, item ids)."""
    windows = {}
    for item_id, text in items:
        w = dc.words_of(text or "")
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[i:i + window]), set()).add(item_id)
    out = []
    for text in docs:
        w = dc.words_of(text or "")
        hit, ids = set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if tuple(w[i:i + size]) in windows:
                    hit.update(range(i, i + size))
                    ids |= windows[tuple(w[i:i + size])]
        out.append((len(w), hit, sorted(str(x) for x in ids if x is not None)))
    return out


def check(spark, docs, items):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {r["doc_id"]: r for r in dc.find_spans(frame, bench, keep=["doc_id"]).collect()}
    for i, (n, hit, ids) in enumerate(brute(docs, items)):
        r = found[i]
        got = {p for a, b in zip(r["hit_start"], r["hit_end"]) for p in range(a, b)}
        assert (r["n_words"], got, r["items"]) == (n, hit, ids), docs[i]


def test_spans_match_brute_force(spark):
    a = " ".join(f"w{i}" for i in range(14))
    items = [(1, a), (2, "Short item"), (3, ""), (4, None), (5, "Short item"), (None, "nameless one"), (6, "a a a a a a a a a a a")]
    docs = ["x " + a.upper() + " y " + a, "short ITEM, short item", "w0 w1 w2", "a " * 40, "", None, "nameless one!", "SHORT-item",
            " ".join(f"w{i}" for i in range(3, 14)), "x " * 5000 + a]
    check(spark, docs, items)
    check(spark, docs, [])
    check(spark, [], items)


def test_spans_match_brute_force_on_the_tables(spark):
    docs = [r["text"] for r in documents(spark).select("text").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    check(spark, docs, items)


def test_blocks_give_the_same_result(spark, monkeypatch):
    docs, bench = documents(spark), spark.read.parquet(f"{SF}/benchmark.parquet")
    one = sorted(map(repr, dc.find_spans(docs, bench, keep=["doc_id"]).collect()))
    monkeypatch.setattr(dc, "BLOCK_CHARS", 2000)
    assert sorted(map(repr, dc.find_spans(docs, bench, keep=["doc_id"]).collect())) == one


def test_cuts_do_not_depend_on_blocks(spark, monkeypatch):
    """One item inside another in a document: whichever block comes first, nothing of both stays."""
    a = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    b = "one two three four five six seven eight nine ten"
    halves = a.split()
    rows = [(1, f"left start words {' '.join(halves[:5])} {b} {' '.join(halves[5:])} the end", 0),
            (2, f"{b} and {a}", 0), (3, "nothing here", 12), (4, b, 0), (5, None, None), (6, f"x {b[:-4]} {b} {b[-3:]} y", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    items = [(1, a), (2, b)] + [(i, f"filler {i} " + "word " * 12 + str(i)) for i in range(3, 9)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(repr, dc.decontaminate(docs, bench, n_chars="n_chars").collect()))
    assert "four" not in "".join(one).replace("n_chars", "") and "kappa" not in "".join(one)
    for chars in (30, 60, 200):
        monkeypatch.setattr(dc, "BLOCK_CHARS", chars)
        assert sorted(map(repr, dc.decontaminate(docs, bench, n_chars="n_chars").collect())) == one
    assert dc.decontaminate(docs.limit(0), bench, n_chars="n_chars").collect() == []


def test_kept_columns_of_the_outputs_names_are_replaced(spark):
    docs = spark.createDataFrame([(1, "p q r", "x", "y")], "doc_id long, text string, n_words string, items string")
    out = dc.find_spans(docs, spark.createDataFrame([(2, "p q r")], "item_id long, text string"))
    assert out.columns == ["doc_id", "text", "n_words", "hit_start", "hit_end", "items"]
    assert out.first()["n_words"] == 3 and out.first()["items"] == ["2"]


def test_cut_leaves_clean_texts_alone(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, "p q r")],
                                  "item_id long, text string")
    rows = [(1, "Say: one two three four five six seven eight NINE ten eleven. End", 0), (2, "clean  text\n", 12),
            (3, "p q r", 5), (4, "p p q r q r", 0), (5, None, None), (6, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    out = {r["doc_id"]: r for r in dc.decontaminate(docs, bench, n_chars="n_chars").collect()}
    assert out[1]["text"] == "Say:\n. End" and out[1]["n_chars"] == len("Say:\n. End")
    assert (out[2]["text"], out[2]["n_chars"]) == ("clean  text\n", 12)
    assert 3 not in out and 4 not in out  # nothing is left of them (4: the cut brings a passage together)
    assert out[5]["text"] is None and out[6]["text"] == ""
    assert dc.find_spans(dc.decontaminate(docs, bench), bench).where("size(hit_start) > 0").count() == 0


def test_odd_rows(spark):
    docs, bench = odd_documents(spark), spark.createDataFrame([(1, "word word"), (None, None)], "item_id long, text string")
    out = dc.find_spans(docs, bench)
    assert out.columns == [*docs.columns, "n_words", "hit_start", "hit_end", "items"] and out.count() == docs.count()
    cut = dc.decontaminate(docs, bench)
    assert cut.columns == docs.columns and cut.schema == docs.schema
    assert cut.count() == docs.where("text is null or text not like 'word%'").count()


@pytest.mark.parametrize("seed", range(4))
def test_index_finds_what_scanning_finds(seed):
    rng = np.random.default_rng(seed)
    stream = rng.integers(1, 5, 400)
    index = dc.FMIndex(stream)
    lengths = np.array([1, 2, 3, 5, 8])
    phrases = np.zeros((5, 8), dtype=np.int64)
    for i, n in enumerate(lengths):
        phrases[i, :n] = rng.integers(1, 5, n)
    lo, hi = index.search(phrases, lengths)
    for i, n in enumerate(lengths):
        want = [p for p in range(401 - n) if (stream[p:p + n] == phrases[i, :n]).all()]
        assert sorted(index.locate(np.arange(lo[i], max(lo[i], hi[i]))).tolist()) == want
