"""The pipeline on the smallest tables, stage by stage."""

from __future__ import annotations

import os

import pytest

import corpus_pipeline
from lodestar.llm import decontam, toxicity
from lodestar.llm.common import table
from lodestar.llm.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = table(spark, SF, "documents"), {}
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def test_stages_return_documents(stages):
    columns = stages["documents"].columns
    for name in ("toxicity", "near_duplicates", "decontamination"):
        assert stages[name].columns == columns
    assert stages["mixing"].columns == [*columns, "size", "source_size", "target", "taken"]


def test_each_stage_takes_effect(spark, stages):
    ids = {name: {r.doc_id for r in df.select("doc_id").collect()} for name, df in stages.items()}
    scored = toxicity.toxicity(stages["documents"], table(spark, SF, "labels")).collect()
    assert ids["documents"] - ids["toxicity"] == {r.doc_id for r in scored if r.predicted}
    texts = [r.text for r in stages["near_duplicates"].collect()]
    assert len(texts) == len(set(texts)) <= stages["toxicity"].count()
    bad = {r.doc_id for r in decontam.contaminated(stages["near_duplicates"], table(spark, SF, "benchmark")).collect()}
    assert ids["near_duplicates"] - ids["decontamination"] == bad
    items = [r.text for r in table(spark, SF, "benchmark").collect()]
    assert not any(i in t for i in items for t in (r.text for r in stages["decontamination"].collect()))
    mixed = stages["mixing"].collect()
    assert all(0 < r.taken <= 3 * r.size for r in mixed)


def test_run_equals_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in stages["mixing"].collect())


def test_queries_are_registered():
    assert {q.split("_")[0] for q in QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(ORACLE_SQL) <= set(QUERIES)


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, taken int, leak_id int, kept_id int, mix_id int, `turn of this id` int, mix_turn int, row_key int, fp string, root string"


def odd_documents(spark):
    texts = {0: "a b c d e f", 1: None, 2: "", 3: "long " * 20000, 4: "a b c d e f", 5: "x y"}
    rows = [(i, t, None if i == 2 else "en", None if i == 1 else f"s{i % 2}", None, "clash", 1, 2, 3, 4, 5, 6, 7, "x", "y") for i, t in texts.items()]
    return spark.createDataFrame([*rows, rows[5], (5, "other text", *rows[5][2:]), (None, None, *rows[1][2:]), (None, "no id", *rows[5][2:])], SCHEMA)


def test_stages_take_odd_rows(spark, tmp_path):
    docs = odd_documents(spark)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < 3:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    assert docs.columns == [c for c in odd_documents(spark).columns if c not in ("size", "taken")] + ["size", "source_size", "target", "taken"]


def test_mixing_does_not_multiply_repeated_rows(spark):
    docs = odd_documents(spark)
    out = corpus_pipeline.mix_sources(spark, docs, SF).collect()
    want = [r for r in docs.collect() if (r.text or "").split()]
    assert len(out) <= len(want) and all(r.size == len(r.text.split()) and 0 < r.taken <= 3 * r.size for r in out)


def test_stages_take_empty_tables(spark, tmp_path):
    docs = odd_documents(spark).limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    assert docs.count() == 0
