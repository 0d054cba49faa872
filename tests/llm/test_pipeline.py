"""The pipeline against plain versions of its stages, on the small tables and on planted copies."""

import importlib.util

import pytest

if importlib.util.find_spec("corpus_pipeline") is None:
    pytest.skip("no pipeline here", allow_module_level=True)

import corpus_pipeline
from test_documents import DOCS, plain_fingerprint, plain_groups, plain_line_dedup, row

from shelfwise.llm import common

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = common.table(spark, SF, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 4
    kept = common.written(corpus_pipeline.STAGES[0][1](spark, docs, SF), "t")
    assert kept.columns == docs.columns and 0.5 * docs.count() < kept.count() <= docs.count()
    lines = common.written(corpus_pipeline.STAGES[1][1](spark, kept, SF), "t")
    assert lines.columns == docs.columns
    assert {r.doc_id: r.text for r in lines.collect()} == {k: t for k, (_, _, t) in plain_line_dedup({r.doc_id: r.text for r in kept.collect()}).items()}
    one = common.written(corpus_pipeline.STAGES[2][1](spark, lines, SF), "t")
    groups = plain_groups({r.doc_id: plain_fingerprint(r.text) for r in lines.collect()})
    assert one.columns == docs.columns and sorted(r.doc_id for r in one.collect()) == sorted(set(groups.values()))
    packed = corpus_pipeline.STAGES[3][1](spark, one, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in one.collect()}
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, packed))


def test_stages_keep_rows_and_columns(spark):
    line = "This line stands in many of the documents, and it is long."
    texts = [(k, f"{line}\nbut this is of document number {k} alone, which is {'very ' * k}long, and has words {k * 'of its own '}") for k in range(6)] + [(None, line), (None, None), (3, None)]
    docs = spark.createDataFrame([row(*t) for t in texts], DOCS)
    labels = common.table(spark, SF, "labels").limit(0)
    kept = common.written(corpus_pipeline.quality.reject(docs, labels), "t")
    assert sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))
    lines = common.written(corpus_pipeline.line_deduplication(spark, kept, SF), "t")
    got = {(r.doc_id, r.text) for r in lines.collect()}
    assert lines.columns == docs.columns and {r.n_lines for r in lines.collect()} == {9} and {(None, line), (None, None), (3, None), (5, texts[5][1]), (0, texts[0][1].split("\n")[1])} <= got
    one = corpus_pipeline.near_deduplication(spark, lines, SF)
    assert one.columns == docs.columns and {(r.doc_id, r.text) for r in one.collect()} == got


def test_stages_take_odd_tables(spark):
    texts = {1: None, 2: "", 3: "The same text stands here, word by word, in two.", 4: "The same text stands here, word by word, in two."}
    for rows in ([row(*t) for t in texts.items()], []):
        docs = spark.createDataFrame(rows, DOCS)
        for _, stage in corpus_pipeline.STAGES:
            docs = common.written(stage(spark, docs, SF), "t")
