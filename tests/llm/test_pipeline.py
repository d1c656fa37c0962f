"""The pipeline's stages on a small corpus: columns, what each takes away and what it must leave."""

from __future__ import annotations

import random
import tracemalloc
from collections import Counter

import corpus_pipeline
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from millrace.llm import langid, near_copies, simhash
from millrace.llm.common import TEXTS, scratch, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def small(spark):
    r = random.Random(1)
    en, fr = "the of and to in is house tree with green by this".split(), "le la et des du une maison chat avec vert par dans".split()
    sentence = lambda w: " ".join(r.choice(w) + r.choice(["", "", "x", "yz"]) for _ in range(r.randint(20, 60)))
    rows = [(i, "\n".join(sentence(en if i % 2 else fr) for _ in range(3)), "en" if i % 2 else "fr", f"s{i % 3}") for i in range(90)]
    passage = sentence(en) + " " + sentence(en)
    rows = [(i, f"{t}\n{passage}" if i in (10, 20, 30) else t, lang, s) for i, t, lang, s in rows]
    rows += [(100, rows[3][1], "en", "s1"), (101, rows[4][1] + " end", "fr", "s1"), (102, None, None, "s0"), (103, "12 34 !!", "en", None)]
    return spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], "doc_id long, text string, lang string, source string, n_chars long"), rows, passage


def test_stages(spark):
    docs, rows, passage = small(spark)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        path = scratch(spark, "stage-test")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = docs.collect()
        if name != "pack_sequences":
            assert docs.columns == COLUMNS
    assert {r.doc_id for r in kept["language_id"]} == {x[0] for x in rows} - {102, 103}
    by = {r.doc_id: r for r in kept["line_dedup"]}
    assert [i for i in by if passage in by[i].text] == [10] and by[100].text == "" and all(r.n_chars == len(r.text) for r in by.values())
    assert {r.doc_id for r in kept["near_dedup"]} <= set(by) and len({r.doc_id for r in kept["near_dedup"]}) == len(kept["near_dedup"])
    copies = Counter(r.doc_id for r in kept["mix_sources"])
    assert set(copies) <= {r.doc_id for r in kept["near_dedup"]} and max(copies.values()) <= 3
    words = Counter()
    for r in kept["pack_sequences"]:
        words[r.doc_id] += r.n_words
    text = {r.doc_id: r.text for r in kept["mix_sources"]}
    assert words == {i: n * len(text[i].split()) for i, n in copies.items()}


def test_near_dedup_keeps_one_of_each_group(spark):
    docs, rows, _ = small(spark)
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert {x[0] for x in rows[:90]} <= got and 100 not in got


def test_near_dedup_drops_near_copies(spark):
    docs, rows, _ = small(spark)
    assert 101 not in {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}


def test_stages_of_odd_tables(spark):
    """Empty tables, repeated rows without ids, and further columns whose names the stages use inside, in every stage but the last."""
    docs, rows, _ = small(spark)
    odd = docs.where("doc_id < 12").unionByName(spark.createDataFrame([(None, "the tree is in the green house", "en", None, 5)] * 3, docs.schema))
    names = {"n_lines": 1, "n_removed": 2, "score": 3, "lang_pred": 4, "root": 5, "no_id": 6, "did": 7, "th": 8, "copies": 9, "nth": 10, "own": 11, "its_key": 12, "gone": 13}
    for name, value in names.items():
        odd = odd.withColumn(name, F.lit(value))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, odd, "")
        assert got.columns == odd.columns, name
        assert {tuple(r[c] for c in names) for r in got.collect()} == {tuple(names.values())}, name
        assert stage(spark, docs.where("false"), "").count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, odd, "").count() == odd.count()


def test_python_steps_hold_few_texts(spark, monkeypatch):
    """Steps of near_dedup that hold whole texts get them in small batches, and the session's setting stays as it was."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    seen = written(spark.range(3000).coalesce(1).mapInArrow(sizes, "n long"), "batch-test", TEXTS).agg(F.max("n"), F.sum("n")).first()
    assert seen[0] <= TEXTS and seen[1] == 3000 and spark.conf.get(key) == before
    bounds = {}

    def spy(df, name, batch=None):
        bounds[name] = batch
        return written(df, name, batch)

    monkeypatch.setattr(near_copies, "written", spy)
    monkeypatch.setattr(simhash, "written", spy)
    docs, *_ = small(spark)
    corpus_pipeline.near_dedup(spark, docs, "").count()
    assert {bounds[name] for name in ("near-rows", "near-edges", "fingerprints")} == {TEXTS}


def test_language_id_sends_each_text_once(spark, monkeypatch):
    told, predict = [], langid.predict
    monkeypatch.setattr(langid, "predict", lambda docs, model: told.append(docs.schema.simpleString()) or predict(docs, model))
    docs, *_ = small(spark)
    corpus_pipeline.language_id(spark, docs, "").count()
    assert told[0].count("string") == 2, "text and source"


def test_fit_takes_no_copy_of_the_sample():
    """A fit on some rows of the sample works on the sample itself: beside it, it takes much less than those rows."""
    r = np.random.default_rng(1)
    x = r.random((1000, langid.DIM + 1), dtype=np.float32)
    rows = np.arange(0, 1000, 2)
    y = np.where(x[rows, 0] > 0.5, 1, -1)
    tracemalloc.start()
    w = langid.fit_svm(x, rows, y, epochs=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < x[rows].nbytes / 2 and np.array_equal(w, langid.fit_svm(x[rows], np.arange(500), y, epochs=2))
