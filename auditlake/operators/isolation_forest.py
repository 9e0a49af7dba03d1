"""Isolation forest (Liu, Ting and Zhou, 2008) with one tree per task.

Every tree samples at most ``forest_sample`` rows by hash, so no group grows with the data; the
fitted trees are bounded by trees x sample and travel to the scoring tasks as a closure.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.params import Params

TREE_SCHEMA = (
    "tree int, feature array<int>, threshold array<double>, low array<int>, high array<int>, "
    "rows array<int>, depth array<int>"
)
_EULER = 0.5772156649015329


def expected_path(n: np.ndarray) -> np.ndarray:
    """Average path length of an unsuccessful search among ``n`` points."""
    n = np.asarray(n, dtype=float)
    big = 2.0 * (np.log(np.maximum(n - 1.0, 1.0)) + _EULER) - 2.0 * (n - 1.0) / np.maximum(n, 1.0)
    return np.where(n <= 1, 0.0, np.where(n <= 2, 1.0, big))


def tree_samples(vectors: DataFrame, n_rows: int, params: Params) -> DataFrame:
    """(tree, x) with up to ``forest_sample`` rows per tree, independent of partitioning.

    A hash threshold first thins the rows to the sample plus eight deviations; the smallest hashes win.
    """
    wanted = min(params.forest_sample, n_rows)
    keep = min(1.0, (wanted + 8.0 * math.sqrt(wanted) + 8.0) / max(n_rows, 1))
    trees = F.sequence(F.lit(0), F.lit(params.forest_trees - 1))
    unit = lambda t: F.pmod(F.xxhash64(F.col("provider_id"), t, F.lit(params.seed)), F.lit(1 << 30))
    limit = F.lit(int(keep * (1 << 30)))
    drawn = vectors.withColumn("tree", F.explode(F.filter(trees, lambda t: unit(t) < limit)))
    return drawn.select("tree", "x", unit(F.col("tree")).alias("draw"), "provider_id")


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> dict[str, list]:
    nodes: dict[str, list] = {k: [] for k in ("feature", "threshold", "low", "high", "rows", "depth")}
    pending = [(np.arange(len(x)), 0, -1, "")]
    while pending:
        rows, depth, parent, side = pending.pop()
        me = len(nodes["feature"])
        if parent >= 0:
            nodes[side][parent] = me
        for key, value in (("feature", -1), ("threshold", 0.0), ("low", -1), ("high", -1),
                           ("rows", len(rows)), ("depth", depth)):
            nodes[key].append(value)
        if depth >= limit or len(rows) <= 1:
            continue
        sub = x[rows]
        smallest, largest = sub.min(axis=0), sub.max(axis=0)
        varying = np.flatnonzero(largest > smallest)
        if not len(varying):
            continue
        f = int(varying[rng.integers(len(varying))])
        cut = float(rng.uniform(smallest[f], largest[f]))
        goes_low = sub[:, f] <= cut
        nodes["feature"][me], nodes["threshold"][me] = f, cut
        pending.append((rows[~goes_low], depth + 1, me, "high"))
        pending.append((rows[goes_low], depth + 1, me, "low"))
    return nodes


def fit_forest(vectors: DataFrame, n_rows: int, params: Params) -> list[dict]:
    """Fit all trees in parallel; returns them as plain arrays (bounded by the parameters)."""
    wanted = min(params.forest_sample, n_rows)
    limit = max(1, math.ceil(math.log2(max(wanted, 2))))
    seed = params.seed

    def one_tree(table: pa.Table) -> pa.Table:
        chosen = table.sort_by([("draw", "ascending"), ("provider_id", "ascending")]).slice(0, wanted)
        tree = chosen["tree"][0].as_py()
        x = chosen["x"].combine_chunks().flatten().to_numpy().reshape(len(chosen), -1)
        grown = _grow(x, np.random.default_rng([seed, tree]), limit)
        return pa.table({
            "tree": pa.array([tree], pa.int32()),
            **{k: pa.array([v], pa.list_(pa.float64() if k == "threshold" else pa.int32())) for k, v in grown.items()},
        })

    fitted = tree_samples(vectors, n_rows, params).groupBy("tree").applyInArrow(one_tree, TREE_SCHEMA)
    return [
        {k: np.asarray(row[k]) for k in ("feature", "threshold", "low", "high", "rows", "depth")}
        for row in fitted.orderBy("tree").collect()
    ]


def leaf_of(tree: dict, x: np.ndarray) -> np.ndarray:
    """Leaf index of every row of ``x``."""
    at = np.zeros(len(x), dtype=int)
    for _ in range(int(tree["depth"].max())):
        f = tree["feature"][at]
        inner = f >= 0
        if not inner.any():
            break
        goes_low = x[np.arange(len(x)), np.maximum(f, 0)] <= tree["threshold"][at]
        at = np.where(inner, np.where(goes_low, tree["low"][at], tree["high"][at]), at)
    return at


def forest_scores(vectors: DataFrame, trees: list[dict], n_rows: int, params: Params) -> DataFrame:
    """provider_id and ``score_samples``: minus the anomaly score, in (-1, 0)."""
    base = float(expected_path(np.array([min(params.forest_sample, n_rows)]))[0]) or 1.0
    model = vectors.sparkSession.sparkContext.broadcast(trees)

    def score(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["x"].to_numpy())
            length = np.zeros(len(x))
            for tree in model.value:
                leaf = leaf_of(tree, x)
                length += tree["depth"][leaf] + expected_path(tree["rows"][leaf])
            yield pd.DataFrame({
                "provider_id": pdf["provider_id"],
                "score_samples": -np.power(2.0, -length / (len(model.value) * base)),
            })

    id_type = dict(vectors.dtypes)["provider_id"]
    return vectors.mapInPandas(score, f"provider_id {id_type}, score_samples double")
