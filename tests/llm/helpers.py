"""Fixtures shared by the tests of the training-data operators."""

from __future__ import annotations

SF = "/root/testdata/sf0.001"

ODD_TEXTS = ["", " ", "\n", "\n\n\n", None, "a", "a b", "  two  spaces ", "it's 'S 1½² x\x85y　z", "\x00\x01 \x1c a",
             "日本語テキスト " * 5, "😀👍🏽 é́", "<|endoftext|> </s>[INST] x", "tab\there\r\nthere", "a", "word " * 30_000, "x" * 5_000]


def odd_documents(spark):
    """Documents with NULLs, blank, long and repeated texts, repeated and NULL ids, and columns
    whose names the operators use themselves."""
    rows = [(i if i % 7 else None, t, "en", None if i % 3 else "src", 0, "c0", 1, "x", 2.0, True)
            for i, t in enumerate(ODD_TEXTS + ODD_TEXTS)]
    rows += [rows[-3]] * 2
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, c0 string, fp long, "
              "component string, score double, like boolean")


def documents(spark, limit=None):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
