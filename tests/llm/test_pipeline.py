import pytest
from helpers import rows_of
from pyspark.sql import functions as F

import corpus_pipeline
from xxhash import xxh64_intdigest

from rillmark.llm.common import discard, stored_at
from rillmark.llm import byte_bpe, decontamination, line_windows, quality, simhash
from test_decontamination import plain as plain_hits
from test_dedup import components, plain_fingerprint, plain_lines


def test_stages_are_named_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "byte_bpe"]


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """The documents before and after each stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], sf_dir).persist())
    return out


def pairs(df):
    return [tuple(r) for r in df.select("doc_id", "text").orderBy("doc_id").collect()]


def test_each_stage_equals_its_plain_form_on_its_own_input(spark, sf_dir, stages):
    docs, good, cut, single, clean, tokens = stages
    assert all(s.columns == docs.columns for s in stages[1:-1])
    scores = {r["doc_id"]: r["score"] for r in quality.classify(docs, quality.training_rows(spark, sf_dir)).collect()}
    assert pairs(good) == [p for p in pairs(docs) if scores[p[0]] >= 0.5]
    assert pairs(cut) == sorted((r[0], r[1]) for r in plain_lines(pairs(good)))
    assert cut.where("n_chars <> char_length(text)").count() == 0
    rows = pairs(cut)
    roots = components([plain_fingerprint(t) for _, t in rows])
    assert pairs(single) == [r for i, r in enumerate(rows) if roots[i] == i]
    bench = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    hits = {r[0]: r[2] for r in plain_hits(pairs(single), bench)}
    assert pairs(clean) == [p for p in pairs(single) if not hits[p[0]]]
    assert rows_of(tokens, "doc_id") == rows_of(clean, "doc_id")


def test_clean_labelled_documents_stay(spark, sf_dir, stages):
    marks = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    before = stages[0].join(marks, "doc_id").count()
    assert stages[1].join(marks, "doc_id").count() >= 0.97 * before


def test_run_equals_its_stages(spark, sf_dir, stages):
    got = corpus_pipeline.run(spark, sf_dir)
    assert rows_of(got, "doc_id", "ids_sha256") == rows_of(stages[-1], "doc_id", "ids_sha256")
    assert got.agg(F.count("*")).first()[0] > 0


def test_stages_take_edge_rows(spark, sf_dir, stages):
    """Nulls, empty and repeated rows, shared and missing ids, further columns with clashing names."""
    good = [r[1] for r in pairs(stages[1])][:6]
    rows = [(1, good[0]), (1, good[0]), (2, good[1]), (2, "# # | | <> <>"), (None, good[2]), (None, "$$$ *** |||"), (None, good[2]), (3, None), (4, ""), (5, good[3] + "\nx"), (-7, good[4])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "w", "k") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, fp long, words string, key string")
    kept = corpus_pipeline.quality_filter(spark, docs, sf_dir)
    scores = {(r["doc_id"], r["key"]): r["score"] for r in quality.classify(docs, quality.training_rows(spark, sf_dir)).collect()}
    assert len(scores) == len(set(rows)) and kept.columns == docs.columns
    signed = lambda t: 42 if t is None else (h := xxh64_intdigest(t.encode(), 42)) - (h >> 63 << 64)
    assert sorted(map(repr, pairs(kept))) == sorted(repr(r) for r in rows if scores[r[0], signed(r[1])] >= 0.5)
    for name, stage in corpus_pipeline.STAGES[1:]:
        docs = stage(spark, docs, sf_dir)
        assert name == "byte_bpe" or docs.columns[:2] == ["doc_id", "text"]
        assert docs.count() >= 6
    assert {r["doc_id"] for r in docs.collect()} >= {1, 2, -7, None}


def test_run_deletes_what_stages_are_done_with(spark, sf_dir, monkeypatch):
    stored, gone = [], []
    monkeypatch.setattr(corpus_pipeline, "stored_at", lambda df: stored.append(stored_at(df)) or stored[-1])
    monkeypatch.setattr(corpus_pipeline, "discard", lambda spark, path: gone.append(path) or discard(spark, path))
    corpus_pipeline.run(spark, sf_dir).count()
    assert len(stored) == 4 and gone == [path for _, path in stored[:-1]]


def test_stages_on_no_rows(spark, sf_dir, stages):
    docs = stages[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_operators_are_those_of_the_stages():
    assert {byte_bpe, decontamination, line_windows, quality, simhash} <= {m for m in vars(corpus_pipeline).values() if hasattr(m, "__file__")}
