import zlib

import pytest
import zstandard
from helpers import odd_documents, rows_of
from pyspark.sql import functions as F

from tally.llm import lang_id, queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return lang_id.fit(docs, F.crc32(F.col("doc_id").cast("string")) % 3 != 1)


def test_held_out_accuracy(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op11_lang_id(spark, SF).collect()
    assert len(rows) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)
    out = [r for r in rows if r["held_out"]]
    right = [r["lang_pred"] == truth[r["doc_id"]] for r in out]
    assert sum(right) / len(right) >= 0.98
    sure = [r["lang_pred"] == truth[r["doc_id"]] for r in out if r["accepted"]]
    assert len(sure) >= 0.95 * len(out) and sum(sure) / len(sure) >= 0.995


def test_labels_of_held_out_rows_and_other_columns_do_not_matter(spark, docs, model):
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    other = docs.withColumn("lang", F.when(held, "xx").otherwise(F.col("lang"))).withColumn("source", F.lit(None).cast("string"))
    again = lang_id.fit(other, ~held)
    assert (again.languages, again.contents) == (model.languages, model.contents)
    renamed = docs.withColumn("lang", F.lit("zz")).withColumn("doc_id", -F.col("doc_id"))
    a = lang_id.identify(docs, model, ["doc_id"]).select(F.col("doc_id"), "lang_best", "lang_margin")
    b = lang_id.identify(renamed, again, ["doc_id"]).select((-F.col("doc_id")).alias("doc_id"), "lang_best", "lang_margin")
    assert rows_of(a) == rows_of(b)


def test_copies_and_partitions_do_not_change_the_sample(docs, model):
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    hot = docs.where(~held).limit(1).crossJoin(docs.sparkSession.range(300)).drop("id")
    again = lang_id.fit(docs.where(~held).unionByName(hot).repartition(7), F.lit(True))
    assert again.contents == model.contents
    assert all(len(c) <= lang_id.SLOTS * (4 * lang_id.PIECE + 1) for c in again.contents)


def test_sizes_are_those_of_a_plain_encoder(docs, model):
    for r in docs.orderBy(F.length("text").desc()).limit(3).collect() + docs.orderBy("doc_id").limit(20).collect():
        raw = " ".join("".join(c if c > "\x7f" or c.isalpha() else " " for c in r["text"].lower()).split(" ")).encode()
        raw = b" ".join(raw.split())
        sizes = []
        for content in model.contents:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=lang_id.LEVEL)
            c = zstandard.ZstdCompressor(level=lang_id.LEVEL, dict_data=d, write_content_size=False)
            sizes.append(sum(len(c.compress(raw[i:i + lang_id.BLOCK])) - len(c.compress(b""))
                             for i in range(0, len(raw), lang_id.BLOCK)))
        assert model.sizes(r["text"]) == sizes
        best, margin = model.classify(r["text"])
        assert sizes[model.languages.index(best)] == min(sizes) and 0 <= margin <= 1


def test_the_end_of_a_long_text_counts(docs, model):
    by = {r["lang"]: r["text"] for r in docs.where(F.length("text") > 3000).collect()}
    assert model.classify(by["de"][:900] + " " + by["fr"] * 20)[0] == "fr"
    assert model.classify(by["fr"][:900] + " " + by["de"] * 20)[0] == "de"


def test_odd_rows(spark, model):
    df = odd_documents(spark).withColumn("lang_pred", F.lit("clash")).withColumn("lang_best", F.lit(1))
    out = lang_id.identify(df, model)
    assert len(set(out.columns)) == len(out.columns) and "lang_pred" in out.columns
    rows = out.collect()
    assert len(rows) == df.count()
    for r in rows:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_best"] == "und") == (not letters), r["text"]
        assert r["lang_pred"] in (r["lang_best"], "und")
        assert r["lang_pred"] != "und" or r["lang_margin"] < lang_id.MIN_MARGIN
        assert 0 <= r["lang_score"] <= 1


def test_narrow_margins_are_rejected(spark, docs, model):
    both = {r["lang"]: r["text"] for r in docs.where(F.length("text") > 3000).collect()}
    mixed = spark.createDataFrame([(1, "x"), (2, both["en"]), (3, None)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in lang_id.identify(mixed, model).collect()}
    assert found[1]["lang_pred"] == "und" and found[1]["lang_best"] != "und"
    assert found[2]["lang_pred"] == "en" and found[2]["lang_score"] > 0.5
    assert found[3]["lang_best"] == "und" and found[3]["lang_score"] == 0


def test_models_of_no_or_one_language_and_too_many(spark, docs):
    none = lang_id.fit(docs.limit(0), F.lit(True))
    assert none.languages == []
    assert {r["lang_best"] for r in lang_id.identify(docs, none, ["doc_id"]).collect()} == {"und"}
    assert lang_id.identify(docs.limit(0), none).collect() == []
    one = lang_id.fit(odd_documents(spark), F.lit(True))
    assert one.languages == ["en"] and one.classify("word")[1] == 1.0
    nothing = lang_id.fit(odd_documents(spark).withColumn("lang", F.lit(None).cast("string")), F.lit(True))
    assert nothing.languages == []
    with pytest.raises(ValueError, match="max_languages"):
        lang_id.fit(docs, F.lit(True), max_languages=2)
