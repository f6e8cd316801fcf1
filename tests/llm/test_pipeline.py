import importlib

import pytest

import corpus_pipeline
from aqengine.llm import decontam, langid, mixing, simhash, tokens

from .conftest import ODD, frame, words


def test_stages_follow_each_other(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    langs = {r.doc_id for r in langid.predict(docs, langid.fit(docs)).filter("not rejected").collect()}
    kept = docs.filter(docs.doc_id.isin(*langs))
    ones = {r.doc_id for r in simhash.near_duplicates(kept).filter("doc_id = component_id").collect()}
    kept = kept.filter(docs.doc_id.isin(*ones))
    leaks = {r.doc_id for r in decontam.contaminated(kept, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    kept = kept.filter(~docs.doc_id.isin(*leaks))
    copies = {r.doc_id: r.copies for r in mixing.mix_sources(kept).collect() if r.copies}
    single = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in tokens.round_trip(kept).collect()}
    want, at = [], 0
    for i in sorted(copies):
        for _ in range(copies[i]):
            want.append((i, at, *single[i]))
            at += single[i][0]
    got = [tuple(r) for r in corpus_pipeline.run(spark, sf_dir).orderBy("start").collect()]
    assert got == want and len(langs) > len(ones) > len(kept.collect()) > 0


def test_every_stage_takes_odd_and_no_rows(spark, odd, none, sf_dir):
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd, none):
            out = stage(spark, docs, sf_dir)
            assert name == "token_ids" or out.columns == docs.columns
            out.collect()


def test_clean_documents_stay(spark, sf_dir):
    rows = [(i, words(i, 50), "en", "s", 0, 0.0, 0, 0, 0, 0, "") for i in range(50)]
    docs = frame(spark, rows)
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 50


def test_entry_works_without_this_folder(monkeypatch):
    entry = importlib.import_module("__spark_entry__")
    assert "pipeline" in entry.queries() and "op1_mix_sources" in entry.oracle_sql()
    monkeypatch.setitem(__import__("sys").modules, "corpus_pipeline", None)
    assert "pipeline" not in entry.queries() and "avg_city_hour" in entry.queries()
    monkeypatch.undo()
    assert pytest and ODD
