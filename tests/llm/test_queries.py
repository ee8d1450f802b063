"""Registered queries: all there, results by contract, and the same as SQL where there is SQL."""

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from repometrics.llm import queries
from testbed.compare import connect

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op2": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op3": "doc_id start n_tokens ids_crc32",
    "op4": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op5": "doc_id class_id n_links",
    "op6": "doc_id n_words n_tokens",
    "op7": "doc_id n_words n_removed kept_sha256",
    "op8": "page_id host path rule verdict",
    "op9": "doc_id piece start length ids_crc32 sequence_id offset",
    "op10": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op11": "doc_id leaf subroot root proof_sha256 folded_root verified",
    "op12": "doc_id keep_id group_size kept text_sha256",
    "op13": "lang rank phrase a l r n score",
}


def test_one_query_for_each_operator():
    names = [n for n in contract.queries() if n.startswith("op") and "_" in n and n[2].isdigit()]
    assert sorted(n.split("_")[0] for n in names) == sorted(COLUMNS) and "pipeline" in contract.queries()
    assert queries.ORACLES.keys() <= contract.oracle_sql().keys()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_has_all_rows(spark, name):
    frame = queries.QUERIES[name](spark, SF_DIR)
    assert frame.columns[: len(COLUMNS[name.split("_")[0]].split())] == COLUMNS[name.split("_")[0]].split()
    table, key = {"op8": ("pages", "page_id"), "op13": ("documents", "lang")}.get(name.split("_")[0], ("documents", "doc_id"))
    wanted = {r[0] for r in spark.read.parquet(f"{SF_DIR}/{table}.parquet").select(key).collect()}
    got = [r[0] for r in frame.collect()]
    if name.startswith("op13"):
        # a language has rows if it has a phrase that is frequent enough
        assert got and set(got) <= wanted
        return
    assert set(got) == wanted and (name.startswith("op9") or len(got) == len(wanted))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    frame = queries.QUERIES[name](spark, SF_DIR)
    columns = sorted(frame.columns)
    got = sorted(map(str, (tuple(r[c] for c in columns) for r in frame.collect())))
    cursor = connect(SF_DIR).execute(queries.ORACLES[name])
    place = [[d[0] for d in cursor.description].index(c) for c in columns]
    assert got == sorted(str(tuple(r[k] for k in place)) for r in cursor.fetchall())


def test_pipeline_stage_by_stage(spark, tmp_path):
    """Decisions take effect: rejected documents go, one of each class stays, repeats are cut, the rest is packed."""
    from repometrics.llm import ngram_join, quality, substring_dedup

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    before, frames = docs, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, before, SF_DIR)
        out.write.parquet(f"{tmp_path}/{k}")
        frames.append(before)
        before = spark.read.parquet(f"{tmp_path}/{k}")
    assert all(f.columns == docs.columns for f in frames)
    ids = [{r.doc_id for r in f.select("doc_id").collect()} for f in [*frames, before]]
    assert ids[1] == {r.doc_id for r in quality.judge(docs).filter("kept").collect()} < ids[0]
    assert ids[2] == {r.class_id for r in ngram_join.near_copies(frames[1]).collect()} < ids[1]
    assert ids[3] == ids[4] == ids[2]
    removed = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(frames[2]).collect()}
    texts = [{r.doc_id: r.text for r in f.collect()} for f in frames]
    assert any(removed.values())
    for i, n in removed.items():
        assert len(texts[3][i].split()) == len(texts[2][i].split()) - n and (n or texts[3][i] == texts[2][i])
    assert corpus_pipeline.run(spark, SF_DIR).count() == before.count()
