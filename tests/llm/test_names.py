"""A kept column that has an output's name is replaced, in every operator."""

import corpus_pipeline
import public_tokenizers
from helpers import SF
from pyspark.sql import functions as F

from tally.llm import bpe, html_extract, queries, toxicity, url_filter


def once(df):
    assert len(set(df.columns)) == len(df.columns), df.columns
    return df.collect()


def test_pages(spark):
    html = "<html><body><article><p>Some words of the article.</p></article></body></html>"
    pages = spark.createDataFrame([(1, "http://a.example.net/en/x", html, "T", "H", "P", "R", "V")],
                                  "page_id long, url string, html string, text string, host string, path string, rule string, verdict string")
    assert once(html_extract.extract(pages))[0]["text"] == "Some words of the article."
    row = once(url_filter.judge(pages, queries.URL_RULES))[0]
    assert (row["host"], row["path"], row["rule"], row["verdict"]) == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert row["text"] == "T"


def test_texts(spark):
    docs = spark.createDataFrame([(1, "one two", "i", "n", "s")], "doc_id long, text string, ids string, n_tokens string, score string")
    path = public_tokenizers.path(queries.BPE_RANKS)
    assert isinstance(once(bpe.encode(docs, path, public_tokenizers.PATTERN))[0]["ids"], list)
    row = once(corpus_pipeline.tokenize(spark, docs, SF))[0]
    assert row["n_tokens"] == len(row["ids"]) and row["text"] == "one two" and row["score"] == "s"
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert once(toxicity.score(docs, toxicity.fit(docs, labels)))[0]["score"] == 0.5
    assert docs.select(F.col("score")).first()[0] == "s"
