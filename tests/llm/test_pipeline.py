import corpus_pipeline
import pytest
from helpers import SF, odd_documents

from tally.llm import queries
from tally.llm.common import materialize


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_return_their_columns(spark, name):
    columns = {
        "op1_decontaminate": "doc_id n_words n_hit n_items items_sha256 contaminated", "op2_toxicity": "doc_id held_out score predicted",
        "op3_simhash": "doc_id fingerprint component_id", "op4_html_extract": "page_id url text n_chars",
        "op5_url_filter": "page_id host path rule verdict", "op6_line_dedup": "doc_id n_lines n_removed kept_text",
        "op7_winnow": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
        "op8_chat": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
        "op9_token_store": "doc_id start n_tokens ids_crc32", "op10_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
        "op11_lang_id": "doc_id held_out lang_pred score lang_margin accepted",
        "op12_merkle": "doc_id leaf subroot root proof_sha256 folded_root verified",
        "op13_centroids": "vec_id cluster distance cluster_inertia inertia centroid_sha256"}
    out = queries.QUERIES[name](spark, SF)
    assert out.columns == columns[name].split() and out.count() > 0


def test_stages_chain_and_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, SF), "test")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns, name
        docs = out
        n.append(docs.count())
    assert n == sorted(n, reverse=True) and n[-1] > 0.5 * n[0]
    assert {"ids", "n_tokens", "text", "doc_id"} <= set(docs.columns)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_odd_and_empty_rows(spark, name, stage):
    docs = odd_documents(spark)
    assert stage(spark, docs, SF).count() <= docs.count()
    assert stage(spark, docs.where("false"), SF).count() == 0
