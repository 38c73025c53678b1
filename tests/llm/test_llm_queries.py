"""Registered queries and the pipeline over the driver's tables."""

import collections
import zlib

import duckdb
import pytest

from conftest import SF_DIR
import corpus_pipeline
from ledgerloom.llm.queries import CHECKS, QUERIES
from llm_fixtures import workers_find_the_package  # noqa: F401

COLUMNS = {
    "op1_simhash": "doc_id fingerprint component_id", "op2_decontaminate": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op3_pack": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op4_weighted_sampling": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op5_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op6_langid": "doc_id held_out lang_pred score",
    "op7_secrets": "doc_id n_assign n_access n_hex base_sha256 spans", "op8_substrings": "doc_id n_words n_removed kept_sha256",
    "op9_chat": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op11_fill_in_middle": "doc_id n form prefix_chars middle_chars output_sha256 restored_sha256",
    "op12_quality": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op13_merkle": "doc_id leaf subroot root proof_sha256 folded_root verified",
    "op10_licenses": "doc_id n_words n_base first_word last_word base_labels labels score",
}


def test_every_operator_has_a_query():
    assert sorted(QUERIES) == sorted(COLUMNS)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, name):
    found = QUERIES[name](spark, SF_DIR)
    assert set(COLUMNS[name].split()) <= set(found.columns)
    rows = found.collect()
    source = "conversations" if name == "op9_chat" else "documents"
    key = "conv_id" if name == "op9_chat" else "doc_id"
    want = {r[0] for r in spark.read.parquet(f"{SF_DIR}/{source}.parquet").select(key).collect()}
    assert {r[key] for r in rows} - {-7} == want
    if name in CHECKS:
        con = duckdb.connect()
        for table in ("documents", "benchmark", "conversations"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
        expected = con.execute(CHECKS[name])
        names = [d[0] for d in expected.description]
        assert sorted(map(str, (tuple(r[n] for n in names) for r in rows))) == sorted(map(str, expected.fetchall()))


def test_held_out_languages(spark):
    rows = QUERIES["op6_langid"](spark, SF_DIR).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    held = [r for r in rows if r.held_out]
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) / len(held) > 0.95


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / name)
        stage(spark, docs, SF_DIR).write.parquet(path)
        docs = spark.read.parquet(path)
        counts.append(docs.count())
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns and counts[-1] <= counts[-2]
            survivors = docs
    kept = {r.doc_id: r.text for r in survivors.collect()}
    assert len(kept) == counts[-2] and 0.6 * counts[0] < len(kept) < counts[0]
    assert collections.Counter(kept.values()).most_common(1)[0][1] == 1
    assert not any("AKIA" in t and len(t) < 25 for t in kept.values())
    assert {r.doc_id for r in docs.collect()} == set(kept)
    again = corpus_pipeline.run(spark, SF_DIR)
    assert {r.doc_id for r in again.select("doc_id").distinct().collect()} == set(kept)
    nothing = spark.createDataFrame([], survivors.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, SF_DIR).count() == 0
