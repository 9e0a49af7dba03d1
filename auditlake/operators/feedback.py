"""Semi-supervised layer: auditor dispositions train a classifier that scores every provider."""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.functions.numbers import rounded
from auditlake.params import Params
from auditlake.session import materialize

OUTCOMES = ("confirmed", "cleared")
FEATURES = (
    "claims_per_day", "avg_billed", "avg_minutes", "top_tier_share", "services_per_patient",
    "kl_divergence", "cosine_distance", "ml_score", "cusum_score", "spike_ratio",
)


def checked_dispositions(rows: DataFrame) -> DataFrame:
    """Rows ready to append; an outcome outside the vocabulary fails the write."""
    known = F.col("outcome").isin(*OUTCOMES)
    failure = F.raise_error(F.concat(F.lit("unknown outcome: "), F.coalesce("outcome", F.lit("null"))))
    return rows.withColumn("outcome", F.when(known, F.col("outcome")).otherwise(failure.cast("string")))


def latest_dispositions(rows: DataFrame) -> DataFrame:
    """The last disposition of each provider, as an aggregate rather than a sorted window."""
    last = F.max_by(F.struct("outcome"), "seq")
    return rows.groupBy("provider_id").agg(last.alias("d")).select(
        "provider_id", "d.outcome", (F.col("d.outcome") == "confirmed").cast("int").alias("label")
    )


def provider_features(
    metrics: DataFrame | None, codemix: DataFrame | None, ml: DataFrame | None, temporal: DataFrame | None
) -> DataFrame:
    """Ten features per provider; a provider missing from one layer gets zeros there."""
    picks = [
        (metrics, FEATURES[:5]), (codemix, FEATURES[5:7]), (ml, FEATURES[7:8]), (temporal, FEATURES[8:]),
    ]
    parts = [t.select("provider_id", *cols) for t, cols in picks if t is not None]
    if not parts:
        raise ValueError("no feature table given")
    fused = parts[0]
    for part in parts[1:]:
        fused = fused.join(part, "provider_id", "full_outer")
    return fused.select(
        "provider_id",
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in fused.columns else F.lit(0.0).alias(c)
          for c in FEATURES],
    )


def training_set(dispositions: DataFrame, features: DataFrame) -> DataFrame:
    """Latest label per provider with its features; a labelled provider is never dropped."""
    return latest_dispositions(dispositions).join(features, "provider_id", "left").fillna(0.0, subset=list(FEATURES))


MODEL_TABLE = (
    "kind string, tree int, node int, feature string, centre double, scale double, value double, low int, high int"
)


@dataclass(frozen=True)
class FeedbackModel:
    """A fitted classifier as rows of ``MODEL_TABLE``.

    Logistic: a row per feature (``value`` is its weight after ``(x - centre) / scale``) and one without feature, the
    intercept.  Boosted: the nodes of each tree; an inner node sends ``x < centre`` to ``low``, the rest to ``high``,
    a leaf has no feature and adds its ``value``; tree -1 is the start value.
    """

    kind: str
    rows: tuple[tuple, ...]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.kind, *row) for row in self.rows], MODEL_TABLE)

    @staticmethod
    def read(table: DataFrame) -> FeedbackModel:
        """From its table, whose size is bounded by the model's own parameters."""
        rows = table.orderBy("tree", "node").collect()
        return FeedbackModel(rows[0]["kind"], tuple(tuple(r)[1:] for r in rows))

    def margin(self) -> Column:
        """Log odds of a confirmed outcome, from the feature columns alone."""
        total = F.lit(0.0)
        if self.kind == "logistic":
            for _, _, feature, centre, scale, value, _, _ in self.rows:
                total = total + (F.lit(value) if feature is None else (F.col(feature) - centre) / scale * value)
            return total
        trees: dict[int, dict[int, tuple]] = {}
        for tree, node, *rest in self.rows:
            trees.setdefault(tree, {})[node] = rest

        def walk(nodes: dict[int, tuple], at: int) -> Column:
            feature, centre, _, value, low, high = nodes[at]
            if feature is None:
                return F.lit(value)
            return F.when(F.col(feature) < centre, walk(nodes, low)).otherwise(walk(nodes, high))

        for nodes in trees.values():
            total = total + walk(nodes, 0)
        return total

    def probability(self) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-self.margin()))


def _logistic(training: DataFrame, params: Params) -> Iterable[tuple]:
    """Maximum likelihood with a ridge of ``feedback_ridge`` on the standardised weights, by Newton steps.

    Every step is one aggregation of the training set; it ends when the gradient is as small as ``feedback_tolerance``
    a row, and halves a step that makes the objective worse.
    """
    stats = training.agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(FEATURES)],
        *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(FEATURES)],
    ).first()
    n, width = stats["n"], len(FEATURES) + 1
    centres = [stats[f"m{i}"] for i in range(len(FEATURES))]
    scales = [stats[f"s{i}"] if stats[f"s{i}"] > 1e-12 * (1 + abs(m)) else 1.0 for i, m in enumerate(centres)]
    z = [((F.col(c) - m) / s).alias(f"z{i}") for i, (c, m, s) in enumerate(zip(FEATURES, centres, scales, strict=True))]
    rows = training.select("label", *z, F.lit(1.0).alias(f"z{width - 1}"))
    ridge = np.diag([params.feedback_ridge] * (width - 1) + [0.0])
    pairs = [(i, j) for i in range(width) for j in range(i + 1)]

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        margin = sum((F.col(f"z{i}") * float(w[i]) for i in range(width)), F.lit(0.0))
        told = rows.withColumn("u", margin).withColumn("p", F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("u"))))
        told = told.withColumn("h", F.col("p") * (F.lit(1.0) - F.col("p")))
        # log(1 + exp(u)) without overflow
        loss = F.greatest("u", F.lit(0.0)) + F.log1p(F.exp(-F.abs("u"))) - F.col("label") * F.col("u")
        sums = told.agg(
            F.sum(loss).alias("loss"), *[F.sum((F.col("p") - F.col("label")) * F.col(f"z{i}")).alias(f"g{i}") for i in range(width)],
            *[F.sum(F.col("h") * F.col(f"z{i}") * F.col(f"z{j}")).alias(f"h{i}_{j}") for i, j in pairs],
        ).first()
        curve = np.zeros((width, width))
        for i, j in pairs:
            curve[i, j] = curve[j, i] = sums[f"h{i}_{j}"]
        slope = np.array([sums[f"g{i}"] for i in range(width)])
        return sums["loss"] + 0.5 * float(w @ ridge @ w), slope + ridge @ w, curve + ridge

    w, best = np.zeros(width), math.inf
    step = np.zeros(width)
    for _ in range(params.feedback_steps):
        loss, slope, curve = at(w)
        if loss > best + 1e-9 * (1 + abs(best)):
            step = step / 2
            w = w - step
            continue
        best = loss
        if np.abs(slope).max() <= params.feedback_tolerance * n:
            break
        step = -np.linalg.solve(curve + 1e-12 * np.eye(width), slope)
        w = w + step
    for i, c in enumerate(FEATURES):
        yield 0, i, c, centres[i], scales[i], float(w[i]), None, None
    yield 0, width - 1, None, None, None, float(w[-1]), None, None


def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray, order: list[np.ndarray], inside: np.ndarray, ridge: float):
    """Best (gain, feature, cut) of the rows ``inside`` by second-order gain, or None; ties go to the first feature."""
    best = None
    whole = g[inside].sum() ** 2 / (h[inside].sum() + ridge)
    for j, sorted_rows in enumerate(order):
        rows = sorted_rows[inside[sorted_rows]]
        values, left_g, left_h = x[rows, j], np.cumsum(g[rows]), np.cumsum(h[rows])
        right_g, right_h = left_g[-1] - left_g, left_h[-1] - left_h
        gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - whole
        allowed = (left_h[:-1] >= 1.0) & (right_h[:-1] >= 1.0) & (values[1:] > values[:-1])
        if not allowed.any():
            continue
        at = int(np.argmax(np.where(allowed, gain[:-1], -np.inf)))
        if gain[at] > 1e-9 and (best is None or gain[at] > best[0] + 1e-9):
            best = (gain[at], j, (values[at] + values[at + 1]) / 2)
    return best


def _boosted(x: np.ndarray, y: np.ndarray, params: Params) -> Iterable[tuple]:
    """Gradient-boosted trees of ``feedback_depth`` levels on the logistic loss, with exact splits."""
    order = [np.argsort(x[:, j], kind="stable") for j in range(x.shape[1])]
    share = y.mean()
    margin = np.full(len(y), math.log(share / (1 - share)))
    yield -1, 0, None, None, None, float(margin[0]), None, None
    ridge = params.feedback_ridge
    for tree in range(params.feedback_trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        open_nodes, nodes = [(0, np.ones(len(y), bool), 0)], 1
        while open_nodes:
            node, inside, depth = open_nodes.pop(0)
            found = _split(x, g, h, order, inside, ridge) if depth < params.feedback_depth else None
            if found is None:
                value = -params.feedback_rate * g[inside].sum() / (h[inside].sum() + ridge)
                margin[inside] += value
                yield tree, node, None, None, None, float(value), None, None
                continue
            _, feature, cut = found
            below = x[:, feature] < cut
            yield tree, node, FEATURES[feature], float(cut), None, None, nodes, nodes + 1
            open_nodes += [(nodes, inside & below, depth + 1), (nodes + 1, inside & ~below, depth + 1)]
            nodes += 2


def _fitted(training: DataFrame, params: Params, kind: str) -> FeedbackModel:
    if kind == "logistic":
        return FeedbackModel(kind, tuple(_logistic(training, params)))
    if kind != "boosted":
        raise ValueError(f"unknown model kind: {kind!r}")
    some = training.orderBy(F.xxhash64("provider_id", F.lit(params.seed)), "provider_id").limit(params.feedback_rows)
    rows = some.select("label", *FEATURES).toPandas()
    return FeedbackModel(kind, tuple(_boosted(rows[list(FEATURES)].to_numpy(float), rows["label"].to_numpy(float), params)))


def fit_feedback(training: DataFrame, params: Params, kind: str = "boosted") -> FeedbackModel | None:
    """A fitted model, or None with too few labels or only one class.

    The logistic model is fitted on all rows, in Spark; the boosted trees on at most ``params.feedback_rows`` of them, those
    with the smallest hash of their id.
    """
    counts = {r["label"]: r["n"] for r in training.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if sum(counts.values()) < params.min_labels or len(counts) < 2:
        return None
    return _fitted(training, params, kind)


def feedback_scores(model: FeedbackModel, features: DataFrame, params: Params) -> DataFrame:
    """Points only above the 0.5 boundary, so cleared providers never gain risk."""
    above = F.least(F.greatest((F.col("p") - 0.5) * 2.0, F.lit(0.0)), F.lit(1.0))
    return features.withColumn("p", model.probability()).select(
        "provider_id",
        rounded(above * params.feedback_cap, 2).alias("feedback_score"),
        rounded("p", 4).alias("feedback_prob"),
        (F.col("p") >= 0.5).cast("int").alias("feedback_label"),
    )


def predicted(model: FeedbackModel, rows: DataFrame) -> DataFrame:
    """``rows`` with ``prediction``, 1 from a probability of one half."""
    return rows.withColumn("prediction", (model.probability() >= 0.5).cast("int"))


_RANGES = 4096


def holdout_split(training: DataFrame, params: Params, share: float = 0.20) -> DataFrame:
    """Adds ``held_out``: a fixed share of each class, those with the smallest hash of their id.

    Hash ranges are counted per class (a few thousand rows); whole ranges fall on either side of the cut, and only the
    one range that holds the cut is ranked.
    """
    hashed = training.withColumn("_hash", F.xxhash64("provider_id", F.lit(params.seed)))
    hashed = hashed.withColumn("_range", F.shiftright("_hash", 52))  # signed, so it ascends with the hash
    counts = hashed.groupBy(F.col("label").alias("_label"), F.col("_range").alias("_r")).agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy("_label")
    before = whole.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    cuts = counts.select(
        "_label", "_r", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), "_n",
        F.rint(F.sum("_n").over(whole) * F.lit(share)).alias("_wanted"),
    )
    on = (F.col("label") == F.col("_label")) & (F.col("_range") == F.col("_r"))
    told = hashed.join(F.broadcast(cuts), on)  # at most classes x 4096 rows
    split = (F.col("_before") < F.col("_wanted")) & (F.col("_before") + F.col("_n") > F.col("_wanted"))
    ranked = F.row_number().over(Window.partitionBy("label", "_range").orderBy("_hash", "provider_id"))
    cut = told.where(split).withColumn("held_out", F.col("_before") + ranked <= F.col("_wanted"))
    clear = told.where(~split).withColumn("held_out", F.col("_before") < F.col("_wanted"))
    return clear.unionByName(cut).drop("_hash", "_range", "_label", "_r", "_before", "_n", "_wanted")


def detection_rates(predicted: DataFrame) -> DataFrame:
    """Detection and false-positive rate of (label, prediction) rows."""
    positive, called = F.col("label") == 1, F.col("prediction") == 1
    return predicted.agg(
        F.count(F.lit(1)).alias("val_size"),
        rounded(F.try_divide(F.count_if(positive & called), F.count_if(positive)), 3).alias("detection_rate"),
        rounded(F.try_divide(F.count_if(~positive & called), F.count_if(~positive)), 3).alias("false_pos_rate"),
    )


def holdout_metrics(training: DataFrame, params: Params, kind: str = "boosted") -> DataFrame:
    """One row of validation metrics: a stratified proxy fit, or the training set if too small."""
    counts = [r["n"] for r in training.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()]
    if sum(counts) >= 10 and len(counts) == 2 and min(counts) >= 2:
        split = materialize(holdout_split(training, params))
        told = predicted(_fitted(split.where(~F.col("held_out")), params, kind), split.where("held_out"))
        method = "stratified_80_20_split_proxy"
    else:
        told = predicted(_fitted(training, params, kind), training)
        method = "training_set_only"
    return detection_rates(told).withColumn("method", F.lit(method))
