"""Language identification in two steps: the family first, then one-versus-one linear SVMs among the family's languages.

Features are hashed letter n-grams of the whole text, scaled to unit length. The classifier is fitted on a bounded sample.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM = 4096
UNKNOWN = "und"
_NOT_LETTERS = re.compile(r"[\W\d_]+")

# Families of ISO 639-1 codes; other codes are a family together.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy af lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz",
    "semitic": "ar he mt am",
    "indic": "hi bn ur mr ne pa gu ta te",
    "east-asian": "zh ja ko",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0].split("_")[0], "other")


def text_features(text: str | None) -> np.ndarray | None:
    """Square roots of hashed 1- to 4-gram counts of the letters (words kept apart by a blank), unit length; None without a letter."""
    letters = _NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    if letters and not letters.replace(" ", "").isalpha():  # numbers that aren't digits, such as halves and circled ones
        letters = " ".join("".join(c if c.isalpha() else " " for c in letters).split())
    if not letters:
        return None
    b = np.frombuffer(f"  {letters}  ".encode("utf-8", "replace"), dtype=np.uint8).astype(np.uint32)
    h, counts = b * np.uint32(0x9E3779B1), np.zeros(DIM)
    for n in range(1, 5):
        if n > 1:
            h = (h[:-1] ^ b[n - 1 :]) * np.uint32(0x85EBCA6B) + np.uint32(n)
        counts += np.bincount((h ^ (h >> np.uint32(15))) % np.uint32(DIM), minlength=DIM)
    x = np.sqrt(counts).astype(np.float32)
    return x / np.linalg.norm(x)


def fit_svm(x: np.ndarray, rows: np.ndarray, y: np.ndarray, l2: float = 1e-4, epochs: int = 12, seed: int = 7) -> np.ndarray:
    """Weights of a linear SVM with hinge loss on the ``rows`` of ``x``, whose last column is the bias's; ``y`` is 1 or -1. Averaged Pegasos in small batches, classes weighted evenly."""
    rng, n = np.random.default_rng(seed), len(y)
    weight = np.where(y > 0, n / (2 * max((y > 0).sum(), 1)), n / (2 * max((y < 0).sum(), 1)))
    w, mean, t, size = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0, 64
    for epoch in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, size):
            k, t = order[at : at + size], t + 1
            rate = 1 / (l2 * (t + 100))
            part = x[rows[k]]
            bad = y[k] * (part @ w) < 1
            w *= 1 - rate * l2
            w += (rate / len(k)) * ((weight[k] * y[k] * bad) @ part)
            w *= min(1.0, 1 / math.sqrt(l2) / max(np.linalg.norm(w), 1e-12))
            if epoch >= epochs // 2:
                mean += w
    return mean / max(np.linalg.norm(mean), 1e-12)


@dataclass
class Model:
    """Languages of each family, a row of weights a family (one against the rest), and one for each pair within a family."""

    families: list[str]
    languages: dict[str, list[str]]
    outer: np.ndarray
    pairs: dict[tuple[str, str], np.ndarray]
    gain: float = 12.0

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        x1 = np.concatenate([x, np.full((len(x), 1), 0.2, dtype=x.dtype)], axis=1)
        margins = x1 @ self.outer.T if len(self.families) > 1 else np.ones((len(x), 1))
        best = margins.argmax(axis=1)
        top = np.sort(margins, axis=1)
        sure = 1 / (1 + np.exp(-self.gain * (top[:, -1] - top[:, -2]))) if len(self.families) > 1 else np.ones(len(x))
        out, score = np.empty(len(x), dtype=object), sure.copy()
        for k, name in enumerate(self.families):
            rows = np.nonzero(best == k)[0]
            langs = self.languages[name]
            votes, margin = np.zeros((len(rows), len(langs))), np.zeros((len(rows), len(langs)))
            for (i, a), (j, b) in combinations(enumerate(langs), 2):
                m = x1[rows] @ self.pairs[a, b]
                votes[:, i] += m > 0
                votes[:, j] += m <= 0
                margin[:, i] += m
                margin[:, j] -= m
            if len(langs) > 1 and len(rows):
                # votes decide, the sum of margins breaks ties
                order = votes + 1 / (2 + np.exp(-np.clip(margin, -50, 50)))
                pick = order.argmax(axis=1)
                score[rows] *= 1 / (1 + np.exp(-self.gain * margin[np.arange(len(rows)), pick] / (len(langs) - 1)))
            else:
                pick = np.zeros(len(rows), dtype=int)
            out[rows] = np.array(langs, dtype=object)[pick]
        return out.tolist(), np.clip(score, 0.0, 1.0)


def _features_of(docs: DataFrame, label: Column) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(lang, x) for lang, x in zip(batch.column(0).to_pylist(), (text_features(t.as_py()) for t in batch.column(1))) if x is not None]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1].astype(np.float16).tobytes() for g in got], pa.binary())], names=["lang", "x"])

    return docs.select(label.alias("lang"), "text").mapInArrow(run, "lang string, x binary")


def fit(labelled: DataFrame, per_language: int = 600) -> Model | None:
    """A model from ``labelled(doc_id, text, lang)``; None if no row has a language and a letter.

    The sample: of each language about ``per_language`` rows of the smallest hashes of doc_id (all, if it has fewer), as whole texts.
    Rows count by language first, so that the sample's share is exact at every size; no more than twice the bound is gathered.
    """
    known = labelled.where("lang is not null and text is not null")
    counts = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}  # a row a language
    if not counts:
        return None
    spot = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.lit(0.0)
    for lang, n in sorted(counts.items()):
        share = F.when(F.col("lang") == lang, min(1.0, per_language / n)).otherwise(share)
    rows = _features_of(known.where(spot <= share), F.col("lang")).limit(2 * per_language * len(counts)).collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r.lang, r.x))  # whatever order they came in
    lang = np.array([r.lang for r in rows])
    # held once, with a last column of the threshold; the rows go as soon as they lie in it
    x = np.full((len(rows), DIM + 1), 0.2, dtype=np.float32)
    for k, r in enumerate(rows):
        x[k, :DIM] = np.frombuffer(r.x, dtype=np.float16)
    del rows
    every = np.arange(len(x))
    of = np.array([family(a) for a in lang])
    families = sorted(set(of))
    languages = {f: sorted(set(lang[of == f])) for f in families}
    outer = np.stack([fit_svm(x, every, np.where(of == f, 1, -1)) for f in families]) if len(families) > 1 else np.zeros((1, DIM + 1))
    pairs = {}
    for f in families:
        for a, b in combinations(languages[f], 2):
            on = np.nonzero((lang == a) | (lang == b))[0]
            pairs[a, b] = fit_svm(x, on, np.where(lang[on] == a, 1, -1))
    return Model(families, languages, outer.astype(np.float32), {k: v.astype(np.float32) for k, v in pairs.items()})


def predict(docs: DataFrame, model: Model | None, chunk: int = 256) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; ``und`` and 0 where the text is null or has no letter, or nothing could be learned.

    Prediction reads the text alone. Columns of ``docs`` other than text pass through; it must not have the two new names.
    """
    kinds = docs.schema.simpleString()[len("struct<") : -1]
    at_text = docs.columns.index("text")
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # bounded by the number of languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                found = [text_features(t.as_py()) for t in part.column(at_text)]
                on = [k for k, x in enumerate(found) if x is not None and own is not None]
                lang, score = [UNKNOWN] * part.num_rows, [0.0] * part.num_rows
                if on:
                    for k, a, s in zip(on, *own.predict(np.stack([found[k] for k in on]))):
                        lang[k], score[k] = a, float(s)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang), pa.array(score)], names=[*part.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of every row of ``docs(doc_id, text, lang, ...)``; learned from rows not held out.

    Null doc_ids aren't held out. Repeated rows stay. An empty table gives an empty one; without a labelled row all is ``und``.
    """
    held = held_out()
    model = fit(docs.where(~held))
    return predict(docs.select("doc_id", held.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def known_language(docs: DataFrame) -> DataFrame:
    """``docs``, with columns of any names, without the rows whose language can't be told (``und``: null texts and those without a letter); ``lang`` becomes the predicted one."""
    held = held_out()
    model = fit(docs.where(~held))
    # the text goes to Python and back once, the other columns beside it under numbers
    named = {c: "text" if c == "text" else f"c{k}" for k, c in enumerate(docs.columns) if c != "lang"}
    told = predict(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in named.items()]), model).where(F.col("lang_pred") != UNKNOWN)
    return told.select(*[F.col(named.get(c, "lang_pred")).alias(c) for c in docs.columns])
