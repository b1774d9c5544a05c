from helpers import odd_documents
from pyspark.sql import functions as F

from tally.llm import queries, toxicity

SF = "/root/testdata/sf0.1"


def test_folding():
    assert toxicity.fold("1d1ot Тhе CL0WN tr@sh d!sgusting DE!! the$$$ ndea 2024 ｉｄｉｏｔ i\u200bdiot") == [
        "idiot", "the", "clown", "trash", "disgusting", "de", "the", "ndea", "2024", "idiot", "idiot"]
    assert toxicity.fold("") == [] and toxicity.fold("  !! ") == []


def test_heaviest_entry_counts_once_and_exceptions_do_not():
    lexicon = toxicity.Lexicon({"clow": 1.0, "clown ": 3.0, "scum ": 2.0}, frozenset({"clown fish"}))
    m = toxicity.Matcher(lexicon)
    assert sorted(w for *_, w in m.matches("clown clowns scum discum".split())) == [1.0, 2.0, 3.0]
    assert m.features("a clown fish swims".split()) == (0.0, 0.0, 0.0)
    assert m.features("a clown swims".split())[2] == 3.0
    assert m.features(["scum"])[1] > m.features(["scum"] + ["x"] * 500)[1] > 0


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs, labels, ~queries.held_out())
    scored = toxicity.score(docs, model, ["doc_id"]).join(labels, "doc_id").where(queries.held_out()).collect()
    toxic = [r["score"] for r in scored if r["toxic"]]
    clean = [r["score"] for r in scored if not r["toxic"]]
    auc = sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean) / len(toxic) / len(clean)
    assert auc > 0.93
    assert sum(s >= 0.5 for s in toxic) / len(toxic) > 0.9
    assert sum(s >= 0.5 for s in clean) / len(clean) < 0.03
    disguised = spark.createDataFrame([(1, "Then 1d1ot is a m0r0n and wоrthless the"), (2, "Then the is a and the")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(disguised, model, ["doc_id"]).collect()}
    assert got[1] >= 0.5 > got[2]


def test_odd_rows(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (1, 0)], "doc_id long, toxic int")
    for given in (labels, labels.where("false"), labels.where("toxic = 1")):
        model = toxicity.fit(docs, given)
        out = toxicity.score(docs, model, out="toxicity")
        assert out.columns == [*docs.columns, "toxicity"] and out.count() == docs.count()
        assert out.where(F.col("toxicity").isNull() | ~F.col("toxicity").between(0, 1)).count() == 0
        assert toxicity.reject(docs, model).schema == docs.schema
    assert toxicity.score(docs.where("false"), model).count() == 0
