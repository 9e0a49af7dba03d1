"""Quality classifier: supervised subword embeddings.

A word stands for itself and its character n-grams, each hashed to one of a fixed number of learnt vectors; a word that repeats the one before it adds
one more. A document is the average of these vectors, and a softmax layer turns it into class probabilities. Vectors and layer are trained by
stochastic gradient descent, one document a step, on a bounded sample of labelled rows.
"""

from __future__ import annotations

import operator
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm import texts

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_PIECE = 1 << 20
#: Bytes of a word; what is longer counts as several words.
_LONGEST = 1 << 12


@dataclass(frozen=True)
class Settings:
    #: Labelled rows that the model is fitted on, at most: those with the smallest hash of their id.
    fit_rows: int = 6_000
    #: Hashed features; bounds the model, whatever the vocabulary.
    buckets: int = 1 << 17
    #: Lengths of the character n-grams of a word, taken with a mark at each end.
    grams: tuple[int, ...] = (3, 4)
    dimensions: int = 16
    epochs: int = 5
    rate: float = 2.0
    seed: int = 13


@dataclass(frozen=True)
class Model:
    vectors: np.ndarray  # buckets x dimensions
    layer: np.ndarray  # dimensions x classes
    bias: np.ndarray  # classes
    settings: Settings


def features(words: list[bytes], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words, and the place of the word that each belongs to.

    A word's features are itself and its character n-grams, repeated ones as often as they occur.
    """
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    plain = b" ".join(words).decode("utf-8", "replace").split(" ")
    size = np.fromiter(map(len, plain), np.int64, len(plain)) + 2
    letters = np.frombuffer("".join(f"<{x}>" for x in plain).encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(plain)), size)
    starts = np.cumsum(size) - size
    powers = np.cumprod(np.full(size.max(), _FACTOR))
    found, owners = [np.add.reduceat(letters * powers[np.arange(len(letters)) - starts[owner]], starts)], [np.arange(len(plain))]
    for n in s.grams:
        if n > len(letters):
            continue
        inside = np.flatnonzero(owner[: len(owner) - n + 1] == owner[n - 1 :])
        key = np.full(len(inside), n, np.uint64)
        for k in range(n):
            key = key * _FACTOR + letters[inside + k]
        found.append(key)
        owners.append(owner[inside])
    return (texts.mix(np.concatenate(found)) % np.uint64(s.buckets)).astype(np.int64), np.concatenate(owners)


def _counted(text: bytes | None) -> tuple[Counter, int]:
    """How often each word occurs, and how many repeat the one before; a very long text is read piece by piece."""
    counts, repeats, at, last = Counter(), 0, 0, None
    while text and at < len(text):
        end = _SPACE.search(text, at + _PIECE)
        end = end.end() if end else len(text)
        found = (text[at:end] if end - at < len(text) else text).split()
        if end - at > 2 * _PIECE or max(map(len, found), default=0) > _LONGEST:
            found = [x[i : i + _LONGEST] for x in found for i in range(0, len(x), _LONGEST)]
        counts.update(found)
        repeats += sum(map(operator.eq, found, found[1:])) + (bool(found) and found[0] == last)
        at, last = end, found[-1] if found else last
    return counts, repeats


def _repeat(s: Settings) -> int:
    """The feature of a word that repeats the one before it."""
    return int(texts.mix(np.array([_FACTOR]))[0] % np.uint64(s.buckets))


def bag(text: bytes | None, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of a text and the share of each; none for a text without words."""
    counts, repeats = _counted(text)
    ids, owner = features(list(counts), s)
    times = np.fromiter(counts.values(), float, len(counts))[owner]
    if repeats:
        ids, times = np.append(ids, _repeat(s)), np.append(times, repeats)
    ids, place = np.unique(ids, return_inverse=True)
    share = np.bincount(place, times, len(ids))
    return ids.astype(np.int32), (share / max(share.sum(), 1)).astype(np.float32)


def probabilities(model: Model, ids: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Softmax over the classes for the average of the vectors."""
    z = share @ model.vectors[ids] @ model.layer + model.bias
    e = np.exp(z - z.max())
    return e / e.sum()


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, s: Settings, classes: int = 2) -> Model:
    """Cross-entropy by stochastic gradient descent with a falling rate."""
    draw = np.random.default_rng(s.seed)
    vectors = draw.uniform(-1 / s.dimensions, 1 / s.dimensions, (s.buckets, s.dimensions)).astype(np.float32)
    layer = np.zeros((s.dimensions, classes), np.float32)
    bias = np.log((np.bincount(labels, minlength=classes) + 1) / (len(labels) + classes)).astype(np.float32)
    model = Model(vectors, layer, bias, s)
    steps, done = s.epochs * len(bags), 0
    for _ in range(s.epochs):
        for i in draw.permutation(len(bags)):
            ids, share = bags[i]
            rate = s.rate * (1 - done / steps)
            done += 1
            rest = probabilities(model, ids, share)
            rest[labels[i]] -= 1
            hidden, back = share @ vectors[ids], layer @ rest
            layer -= rate * np.outer(hidden, rest)
            bias -= 0.05 * rate * rest
            vectors[ids] -= rate * np.outer(share, back)
    return model


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Train on labelled documents: ``docs (doc_id, text)``, ``labels (doc_id, label)`` with labels 0 and 1.

    At most ``settings.fit_rows`` labelled rows take part, so their bags of features (no text) may come to the driver at every size. Rows without id
    or with another label are ignored; a label given twice, and copies of a text, count once (1 wins). Without any row the model gives 0.5. Other
    columns are ignored.
    """
    spark = docs.sparkSession
    labels = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.fit_rows).toPandas()
    sample = spark.createDataFrame(chosen.astype({"doc_id": "int64", "label": "int32"}), "doc_id long, label int")
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy(F.xxhash64("text").alias("key"), F.length("text"))
    rows = rows.agg(F.any_value("text").alias("text"), F.max("label").alias("label")).select("key", "text", "label")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 64):
                batch = whole.slice(at, 64)
                bags = [bag(t, settings) for t in texts.utf8(batch["text"])]
                ids, share = ([x[i].tobytes() for x in bags] for i in (0, 1))
                yield pa.RecordBatch.from_arrays([batch["key"], pa.array(ids), pa.array(share), batch["label"]], names=["key", "ids", "share", "label"])

    seen = rows.mapInArrow(count, "key long, ids binary, share binary, label int").toPandas()
    seen = seen.sort_values(["key", "ids"], kind="stable")  # the fit must not hang on the order of arrival
    bags = [(np.frombuffer(i, np.int32), np.frombuffer(x, np.float32)) for i, x in zip(seen["ids"], seen["share"], strict=True)]
    return train(bags, seen["label"].to_numpy(np.int64), settings)


def score(model: Model, text: Column | str) -> Column:
    """Probability of class 1, 0 to 1; texts without words get the model's bias alone.

    The layer is applied to each vector before they are averaged, so a worker keeps two numbers a word. What is broadcast has
    ``settings.buckets`` numbers.
    """
    s, bias = model.settings, float(model.bias[1] - model.bias[0])
    sent = _spark().sparkContext.broadcast((model.vectors @ (model.layer[:, 1] - model.layer[:, 0])).astype(np.float64))
    memo: dict[bytes, tuple[float, int]] = {}

    @F.pandas_udf("double")
    def scored(column: pd.Series) -> pd.Series:
        margins, out, at = sent.value, [], 0
        repeat = float(margins[_repeat(s)])
        while at < len(column):
            lot, size = [], 0
            while at < len(column) and size < _PIECE:
                text = column.iloc[at].encode() if column.iloc[at] else b""
                lot.append(_counted(text))
                at, size = at + 1, size + len(text)
            if len(memo) >= texts.REMEMBERED:
                memo.clear()
            new = list({word for counts, _ in lot for word in counts if word not in memo})
            ids, owner = features(new, s)
            sums, sizes = np.bincount(owner, margins[ids], len(new)), np.bincount(owner, minlength=len(new))
            memo.update(zip(new, zip(sums.tolist(), sizes.tolist(), strict=True), strict=True))
            for counts, n in lot:
                total = repeat * n
                for word, times in counts.items():
                    margin, found = memo[word]
                    total += margin * times
                    n += found * times
                out.append(total / n if n else 0.0)
        return pd.Series(1 / (1 + np.exp(-np.clip(np.array(out, float) + bias, -30, 30))))

    return scored(text)


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.active()


def scored_documents(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), folds: int = 3, held_out: int = 1) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` per row of ``docs``; the fold ``held_out`` of ``crc32(doc_id)`` is never learnt from.

    Rows without id are scored and count as not held out. Repeated rows get the same score. Null, empty and blank texts get the score of no words. A word
    of more than 4096 bytes counts as several. An empty table gives no rows.
    """
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held_out
    model = fit(docs, labels.where(~held), settings)
    scores = docs.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), score(model, "text").alias("score"))
    return scores.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
