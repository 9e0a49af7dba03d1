"""Toxicity: a factorization machine over hashed terms.

A document's terms are its words and their first four to six letters, hashed into a table of fixed size and taken once each.
Weights and factors are learnt from a bounded sample of labelled rows; the score is
``sigmoid(w0 + sum_i w_i + sum_{i<j} <v_i, v_j>)``, so a term that is harmless alone can be toxic beside another.

Two kinds of terms enter: those that tell the classes apart by themselves, at any lift and for either class, and those that explain
what the first ones leave open, in all texts or in those with a strong term. Two terms of which neither shows in either way (toxic if exactly
one of them is there) are not learnt.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm import texts
from auditlake.llm.stages import stage

_LETTERS = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Settings:
    #: Labelled rows that the model is fitted on, at most: those with the smallest hash of their id.
    fit_rows: int = 20_000
    #: Hashed terms; bounds the model, whatever the vocabulary.
    buckets: int = 1 << 20
    prefixes: tuple[int, ...] = (4, 5, 6)
    factors: int = 8
    #: A term is strong if it is so many times more frequent in toxic texts: terms beside it are tested among those texts, too.
    lift: float = 3.0
    #: A term enters with such a log-likelihood ratio, or such a score test on what the terms with one leave open.
    evidence: float = 15.0
    steps: int = 500
    rate: float = 0.1
    decay: float = 1e-5
    seed: int = 7


@dataclass(frozen=True)
class Model:
    bias: float
    terms: np.ndarray  # sorted hashed terms
    weights: np.ndarray
    factors: np.ndarray
    settings: Settings


class _Terms(dict):
    """Lower-case word to the hashed terms it stands for (those among ``kept``, if given: their places)."""

    def __init__(self, settings: Settings, kept: np.ndarray | None = None):
        super().__init__()
        self.settings, self.place = settings, None
        if kept is not None:
            self.place = {int(t): i for i, t in enumerate(kept)}

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= texts.REMEMBERED:
            self.clear()
        names = [word, *(f"{word[:n]}^" for n in self.settings.prefixes if len(word) >= n)]
        terms = {xxhash.xxh3_64_intdigest(x) % self.settings.buckets for x in names}
        if self.place is not None:
            terms = {self.place[t] for t in terms if t in self.place}
        out = self[word] = tuple(terms)
        return out

    def of(self, text: str | None) -> set[int]:
        out: set[int] = set()
        for found in map(self.__getitem__, set(_LETTERS.findall(text.lower())) if text else ()):
            if found:
                out.update(found)
        return out


def _raw(bias: float, w: np.ndarray, v: np.ndarray, ids: np.ndarray) -> float:
    s = v[ids].sum(0)
    return float(bias + w[ids].sum() + 0.5 * (s @ s - (v[ids] ** 2).sum()))


def _counts(docs: DataFrame, settings: Settings) -> DataFrame:
    """(term, toxic, clean): in how many documents of each class a term occurs; summed in each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((2, settings.buckets), np.int64)
        terms = _Terms(settings)
        for batch in batches:
            for text, label in zip(batch["text"].to_pylist(), batch["label"].to_pylist(), strict=True):
                table[label, list(terms.of(text))] += 1
        met = np.flatnonzero(table.any(0))
        for at in range(0, len(met), 50_000):
            some = met[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(table[1, some]), pa.array(table[0, some])], names=["term", "toxic", "clean"])

    parts = docs.mapInArrow(count, "term long, toxic long, clean long")
    return parts.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _telling(counts: DataFrame, toxic: int, clean: int, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The terms that speak for either class, sorted, at most one for each bucket; and whether they are strong."""
    share_t, share_c = (F.col("toxic") + 0.5) / (toxic + 1), (F.col("clean") + 0.5) / (clean + 1)
    both = (F.col("toxic") + F.col("clean")) / float(toxic + clean)

    def part(seen: Column, of: int) -> Column:
        return F.when(seen > 0, seen * F.log(seen / (both * of))).otherwise(0.0)

    evidence = 2 * (part(F.col("toxic"), toxic) + part(F.col("clean"), clean))
    kept = counts.where(evidence >= settings.evidence).select("term", (share_t / share_c >= settings.lift).alias("strong"))
    kept = kept.toPandas().sort_values("term")
    return kept["term"].to_numpy(np.int64), kept["strong"].to_numpy(bool)


def _explaining(rows: DataFrame, model: Model, strong: np.ndarray) -> np.ndarray:
    """The terms that explain what ``model`` leaves open, by a score test in all texts and in those with a strong term."""
    bias, w, v, known, settings = model.bias, model.weights, model.factors, model.terms, model.settings

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # sums of residuals, of their squares and of the model's variance, as whole millionths: they do not hang on the order of arrival
        table = np.zeros((6, settings.buckets), np.int64)
        terms, places = _Terms(settings), _Terms(settings, known)
        for batch in batches:
            for text, label in zip(batch["text"].to_pylist(), batch["label"].to_pylist(), strict=True):
                ids = np.array(sorted(places.of(text)), np.int64)
                p = 1 / (1 + math.exp(-min(max(_raw(bias, w, v, ids), -30), 30)))
                met = list(terms.of(text))
                parts = np.array([[round(x * 1e6)] for x in (label - p, (label - p) ** 2, p * (1 - p))])
                table[:3, met] += parts
                if strong[ids].any():
                    table[3:, met] += parts
        met = np.flatnonzero(table.any(0))
        for at in range(0, len(met), 50_000):
            some = met[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(x[some]) for x in table)], names=["term", *"abcdef"])

    sums = rows.mapInArrow(add, "term long, a long, b long, c long, d long, e long, f long").groupBy("term").agg(*[F.sum(x).alias(x) for x in "abcdef"])

    def test(rest: str, square: str, variance: str) -> Column:
        # the larger of both: one surprise is no evidence, nor is a small common offset
        return F.coalesce(F.try_divide(F.col(rest).cast("double") * F.col(rest), F.greatest(square, variance) * 1e6), F.lit(0.0))

    found = sums.where((test("a", "b", "c") >= settings.evidence) | (test("d", "e", "f") >= settings.evidence))
    return found.select("term").toPandas()["term"].to_numpy(np.int64)


def _fit(rows: list[np.ndarray], labels: np.ndarray, n_terms: int, s: Settings) -> tuple[float, np.ndarray, np.ndarray]:
    """Logistic loss by Adam over the whole sample at each step."""
    y = labels.astype(float)
    bias = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    w, v = np.zeros(n_terms), np.random.default_rng(s.seed).normal(0, 0.05, (n_terms, s.factors))
    if n_terms == 0 or not len(y):
        return bias, w, v
    ids = np.concatenate(rows)
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])

    def by_doc(x: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(doc, x[:, f], len(rows)) for f in range(x.shape[1])], 1)

    def by_term(x: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(ids, x[:, f], n_terms) for f in range(x.shape[1])], 1)

    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (np.zeros(1), w, v)]
    b = np.array([bias])
    for step in range(1, s.steps + 1):
        sums = by_doc(v[ids])
        raw = b[0] + np.bincount(doc, w[ids], len(rows)) + 0.5 * ((sums**2).sum(1) - np.bincount(doc, (v[ids] ** 2).sum(1), len(rows)))
        g = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y
        grads = (
            np.array([g.mean()]),
            np.bincount(ids, g[doc], n_terms) / len(y) + s.decay * w,
            by_term(g[doc, None] * (sums[doc] - v[ids])) / len(y) + s.decay * v,
        )
        for p, grad, m in zip((b, w, v), grads, moments, strict=True):
            m[0][:] = 0.9 * m[0] + 0.1 * grad
            m[1][:] = 0.999 * m[1] + 0.001 * grad**2
            p -= s.rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    return float(b[0]), w, v


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Fit on labelled documents: ``docs (doc_id, text)``, ``labels (doc_id, label)`` with labels 0 and 1.

    At most ``settings.fit_rows`` labelled rows take part, so broadcasting them is safe at every size. Rows without
    id or with another label are ignored; a label given twice counts once (1 wins). Without rows of both
    classes the model is the share of toxic rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    labels = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.fit_rows).toPandas()
    sample = spark.createDataFrame(chosen.astype({"doc_id": "int64", "label": "int32"}), "doc_id long, label int")
    # copies of a text are one row (toxic if one of them is): else their words would look telling
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy(F.xxhash64("text"), F.length("text"))
    rows = stage(rows.agg(F.any_value("text").alias("text"), F.max("label").alias("label")).select("text", "label"), "labelled")
    toxic, clean = (x or 0 for x in rows.agg(F.sum("label"), F.sum(1 - F.col("label"))).first())
    if not toxic or not clean:
        bias = math.log((toxic + 1) / (clean + 1))
        return Model(bias, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, settings.factors)), settings)
    terms, strong = _telling(_counts(rows, settings), toxic, clean, settings)
    model = _fitted(rows, terms, settings)
    more = np.setdiff1d(_explaining(rows, model, strong), terms)
    return _fitted(rows, np.union1d(terms, more), settings) if len(more) else model


def _fitted(rows: DataFrame, terms: np.ndarray, settings: Settings) -> Model:
    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Terms(settings, terms)
        for batch in batches:
            found = [sorted(words.of(t)) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), batch["label"]], names=["terms", "label"])

    seen = rows.mapInArrow(featurize, "terms array<int>, label int").toPandas()
    order = seen["terms"].map(lambda x: np.asarray(x, ">i4").tobytes()).argsort(kind="stable")  # the fit must not hang on the order of arrival
    seen = seen.iloc[order].sort_values("label", kind="stable")
    bias, w, v = _fit([np.asarray(x, np.int64) for x in seen["terms"]], seen["label"].to_numpy(), len(terms), settings)
    return Model(bias, terms, w, v, settings)


def score(model: Model, text: Column | str) -> Column:
    """Probability that a text is toxic, 0 to 1; null and empty texts get the model's base rate."""
    bias, w, v, terms, settings = model.bias, model.weights, model.factors, model.terms, model.settings
    memo: list[_Terms] = []

    @F.arrow_udf("double")
    def scored(column: pa.Array) -> pa.Array:
        if not memo:
            memo.append(_Terms(settings, terms))
        # few texts at once as Python strings: the batch itself holds them all already
        some = (t for at in range(0, len(column), 500) for t in column.slice(at, 500).to_pylist())
        raw = [_raw(bias, w, v, np.fromiter(x, np.int64, len(x))) if (x := memo[0].of(t)) else bias for t in some]
        return pa.array(1 / (1 + np.exp(-np.clip(np.array(raw, float), -30, 30))), pa.float64())

    return scored(text)


def scored_documents(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), folds: int = 5) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` per row of ``docs``; fold 0 of ``crc32(doc_id)`` is never learnt from."""
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0
    model = fit(docs, labels.where(~held), settings)
    scores = docs.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), score(model, "text").alias("score"))
    return scores.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
