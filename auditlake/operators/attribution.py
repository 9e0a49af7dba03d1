"""Which features make a provider look anomalous to the forest?

Exact Shapley values of the path-dependent tree game (Lundberg et al., 2018).  In a tree each leaf
is a product game over the features on its path: a feature either keeps the row on the path (1 or 0)
or, when unknown, keeps the share of training rows that went that way.  The weights of the subset sizes are
integrals of powers, so a feature's value is the integral of a product over the other features: a polynomial,
which a few nodes integrate exactly.  It depends on a row only by which features keep it on the path, so
it is taken once for all patterns of a leaf, and rows look it up.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions.numbers import rounded
from auditlake.operators import privacy
from auditlake.operators.explain import feature_label
from auditlake.operators.isolation_forest import expected_path
from auditlake.params import Params
from auditlake.session import materialize


def leaf_rules(tree: dict) -> list[tuple[float, list[tuple[int, float, float, float]]]]:
    """(value, [(feature, lower bound, upper bound, share)]) for every leaf of a tree."""
    rules = []
    pending = [(0, {})]
    while pending:
        node, path = pending.pop()
        feature = int(tree["feature"][node])
        if feature < 0:
            value = float(tree["depth"][node] + expected_path(tree["rows"][node:node + 1])[0])
            rules.append((value, [(f, *bounds) for f, bounds in path.items()]))
            continue
        lower, upper, share = path.get(feature, (-np.inf, np.inf, 1.0))
        cut, here = float(tree["threshold"][node]), float(tree["rows"][node])
        for child, low, high in (
            (int(tree["low"][node]), lower, min(upper, cut)), (int(tree["high"][node]), max(lower, cut), upper),
        ):
            went = share * float(tree["rows"][child]) / here
            pending.append((child, {**path, feature: (low, high, went)}))
    return rules


def _values(inside: np.ndarray, shares: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Contribution of every feature of leaves with equally many: ``inside`` (leaf, row, feature), ``shares`` (leaf, feature)."""
    # the product over the others has degree players - 1; n nodes integrate degree 2 n - 1
    nodes, weights = np.polynomial.legendre.leggauss(shares.shape[1] // 2 + 1)
    total = np.zeros(inside.shape)
    for t, w in zip((nodes + 1.0) / 2.0, weights / 2.0, strict=True):
        factor = np.where(inside, (shares * (1.0 - t) + t)[:, None, :], (shares * (1.0 - t))[:, None, :])
        total += w * factor.prod(axis=2, keepdims=True) / factor
    return total * (inside - shares[:, None, :]) * value[:, None, None]


#: rows that meet a tree at once
_ROWS = 1024


def shapley(tree: dict, x: np.ndarray) -> np.ndarray:
    """Contribution of every feature to the path length of every row of ``x``."""
    out = np.zeros((x.shape[1], len(x)))
    rules = [(value, path) for value, path in leaf_rules(tree) if path]
    for players in sorted({len(path) for _, path in rules}):
        group = [(value, path) for value, path in rules if len(path) == players]
        value = np.array([v for v, _ in group])
        feature = np.array([[f for f, *_ in path] for _, path in group])
        low, high, shares = (np.array([[e[i] for e in path] for _, path in group]) for i in (1, 2, 3))
        # columns in the order of their features, so each feature's values follow each other
        column = np.argsort(feature.ravel(), kind="stable")
        met, start = np.unique(feature.ravel()[column], return_index=True)
        few = 1 << players <= max(len(x), 64)
        if few:
            patterns = (np.arange(1 << players)[:, None] >> np.arange(players)) & 1 == 1
            known = _values(np.broadcast_to(patterns, (len(group), *patterns.shape)), shares, value)
            known = known.transpose(0, 2, 1).reshape(-1, 1 << players)[column]
        for i in range(0, len(x), _ROWS):
            xs = x[i:i + _ROWS].T[feature.ravel()]
            inside = (xs > low.reshape(-1, 1)) & (xs <= high.reshape(-1, 1))
            inside = inside.reshape(len(group), players, -1)
            if few:
                pattern = np.zeros((len(group), inside.shape[2]), np.int64)
                for j in range(players):
                    pattern += inside[:, j].astype(np.int64) << j
                parts = np.take_along_axis(known, pattern[column // players], axis=1)
            else:
                parts = _values(inside.transpose(0, 2, 1), shares, value).transpose(0, 2, 1)
                parts = parts.reshape(-1, inside.shape[2])[column]
            out[met, i:i + _ROWS] += np.add.reduceat(parts, start, axis=0)
    return out.T


def attributions(vectors: DataFrame, trees: list[dict], names: list[str]) -> DataFrame:
    """(provider_id, feature, contribution), positive towards anomaly, for the rows given.

    Cost is rows x trees x leaves: pass the listed providers, not everyone.
    """
    model = vectors.sparkSession.sparkContext.broadcast(trees)
    id_type = dict(vectors.dtypes)["provider_id"]

    def explain(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["x"].to_numpy())
            total = np.zeros_like(x)
            for tree in model.value:
                total += shapley(tree, x)
            shown = -total / len(model.value)
            yield pd.DataFrame({
                "provider_id": np.repeat(pdf["provider_id"].to_numpy(), len(names)),
                "feature": np.tile(names, len(pdf)),
                "contribution": shown.ravel(),
            })

    return vectors.mapInPandas(explain, f"provider_id {id_type}, feature string, contribution double")


def feature_explanations(contributions: DataFrame, params: Params) -> DataFrame:
    """Top three features per provider with noised values, labels and privacy stamps.

    ``contributions`` is read twice: pass a materialized frame.
    """
    order = Window.partitionBy("provider_id").orderBy(F.col("contribution").desc(), "feature")
    top = contributions.withColumn("place", F.row_number().over(order)).where(F.col("place") <= 3)
    level = privacy.sensitivity(contributions, "contribution", params).scalar()
    noisy = materialize(
        privacy.with_noise(top, "contribution", ["provider_id", "feature"], params, scale_from=level)
    )
    listed = F.sort_array(F.collect_list(F.struct("place", "feature", "noisy", feature_label(F.col("feature")).alias("label"))))
    per = noisy.groupBy("provider_id").agg(
        listed.alias("l"), F.max("sensitivity").alias("privacy_sensitivity"), F.max("epsilon").alias("privacy_epsilon")
    )
    shown = F.transform(F.filter("l", lambda e: e["noisy"] > 0.001), lambda e: e["label"])
    return per.select(
        "provider_id",
        F.array_join(F.transform("l", lambda e: e["feature"]), "; ").alias("top_features"),
        F.when(F.size(shown) > 0, F.concat(F.lit("Flagged due to: "), F.array_join(shown, ", "), F.lit(".")))
        .otherwise("No dominant single-feature driver.").alias("explanation"),
        *[rounded(F.get("l", F.lit(i))["noisy"], 4).alias(f"shap_top{i + 1}_val") for i in range(3)],
        "privacy_epsilon", "privacy_sensitivity",
        F.lit("Values carry Laplace display noise; this is no formal privacy guarantee.").alias("privacy_note"),
    )
