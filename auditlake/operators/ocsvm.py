"""One-class SVM with an RBF kernel, approximated by random Fourier features (Rahimi and Recht, 2007).

The dual asks for the shortest mean of the rows' features under weights of at most ``1 / (nu n)`` each.  It is solved by
cutting planes: for the weights at hand, the mean of the share ``nu`` of rows with the smallest margins is the direction that
helps most; the best mixture of all such means found so far gives the next weights.  What that mean promises bounds how far the
objective is from its optimum, and the solver stops when the bound is small.  Each step counts margins in bins and sums the features
of the rows below the cut, both reduced in Spark, so the driver sees a few thousand counts and two vectors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions.quantiles import global_quantiles
from auditlake.params import Params
from auditlake.session import materialize

_BINS = 4096


def _projector(n_inputs: int, params: Params):
    rng = np.random.default_rng(params.seed)
    gamma, size = 1.0 / max(1, n_inputs), params.svm_features
    weights = rng.normal(0.0, np.sqrt(2.0 * gamma), size=(n_inputs, size))
    phase = rng.uniform(0.0, 2.0 * np.pi, size=size)

    def project(x: np.ndarray) -> np.ndarray:
        return np.sqrt(2.0 / size) * np.cos(x @ weights + phase)

    return project


def _bins(margins: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Bin of each margin; features are no longer than the root of 2, so all margins lie within the bins."""
    reach = np.sqrt(2.0) * np.linalg.norm(w) + 1e-300
    return np.clip((margins / reach + 1.0) / 2.0 * _BINS, 0, _BINS - 1).astype(np.int32)


def _mixture(gram: np.ndarray, steps: int = 4000) -> np.ndarray:
    """Weights on the simplex that make the mixture shortest, by moving mass between two vectors at a time."""
    mix = np.zeros(len(gram))
    mix[np.argmin(np.diag(gram))] = 1.0
    slope = gram @ mix
    for _ in range(steps):
        to = int(np.argmin(slope))
        off = int(np.argmax(np.where(mix > 0, slope, -np.inf)))
        gain = slope[off] - slope[to]
        if gain <= 1e-14 * (1.0 + abs(slope[off])):
            break
        curve = gram[to, to] + gram[off, off] - 2.0 * gram[to, off]
        move = min(mix[off], gain / curve if curve > 0 else mix[off])
        mix[to] += move
        mix[off] = 0.0 if move == mix[off] else mix[off] - move
        slope = slope + move * (gram[to] - gram[off])
    return mix


def fit_svm(vectors: DataFrame, n_rows: int, n_inputs: int, nu: float, params: Params) -> np.ndarray:
    """Weights of min |w|^2/2 - rho + sum(max(0, rho - w.z)) / (nu n), to a share ``svm_tolerance`` of |w|^2.

    At most ``svm_steps`` steps; ``vectors`` is read twice in each: pass a materialized frame.
    """
    project, size = _projector(n_inputs, params), params.svm_features
    mass = nu * n_rows

    def features(batches):
        for pdf in batches:
            if len(pdf):
                yield project(np.stack(pdf["x"].to_numpy()))

    def summed(w: np.ndarray | None, cut: int) -> np.ndarray:
        """Sums of the features of the rows in bins below the cut, and of those in it."""
        def partial(batches):
            total = np.zeros((2, size))
            for z in features(batches):
                at = np.full(len(z), cut - 1) if w is None else _bins(z @ w, w)
                total[0] += z[at < cut].sum(axis=0)
                total[1] += z[at == cut].sum(axis=0)
            where = np.repeat([0, 1], size), np.tile(np.arange(size), 2)
            yield pd.DataFrame({"part": where[0], "i": where[1], "v": total.ravel()})

        parts = vectors.select("x").mapInPandas(partial, "part int, i int, v double")
        rows = parts.groupBy("part", "i").agg(F.sum("v").alias("v")).collect()
        out = np.zeros((2, size))
        for r in rows:
            out[r["part"], r["i"]] = r["v"]
        return out

    def counted(w: np.ndarray) -> np.ndarray:
        def partial(batches):
            total = np.zeros(_BINS, np.int64)
            for z in features(batches):
                total += np.bincount(_bins(z @ w, w), minlength=_BINS)
            met = np.flatnonzero(total)
            yield pd.DataFrame({"bin": met.astype(np.int32), "n": total[met]})

        parts = vectors.select("x").mapInPandas(partial, "bin int, n long")
        out = np.zeros(_BINS, np.int64)
        for r in parts.groupBy("bin").agg(F.sum("n").alias("n")).collect():
            out[r["bin"]] = r["n"]
        return out

    planes = [summed(None, 1)[0] / n_rows]
    w = planes[0]
    for _ in range(params.svm_steps):
        counts = counted(w)
        upto = np.cumsum(counts)
        cut = int(np.searchsorted(upto, mass))
        below = int(upto[cut - 1]) if cut else 0
        sums = summed(w, cut)
        plane = sums[0] / mass + (1.0 - below / mass) * sums[1] / max(1, counts[cut])
        if w @ (w - plane) <= params.svm_tolerance * (w @ w):
            break
        planes.append(plane)
        stack = np.stack(planes)
        w = _mixture(stack @ stack.T) @ stack
    return w


def svm_scores(vectors: DataFrame, w: np.ndarray, n_inputs: int, nu: float, params: Params) -> DataFrame:
    """provider_id and ``decision``: negative outside the learnt region.

    For fixed weights the best offset is the nu-quantile of the margins, so it is computed exactly.
    """
    project = _projector(n_inputs, params)
    id_type = dict(vectors.dtypes)["provider_id"]

    def score(batches):
        for pdf in batches:
            if len(pdf):
                z = project(np.stack(pdf["x"].to_numpy()))
                yield pd.DataFrame({"provider_id": pdf["provider_id"], "margin": z @ w})

    margins = materialize(vectors.mapInPandas(score, f"provider_id {id_type}, margin double"))
    offset = global_quantiles(margins, "margin", {"q": nu}).select("q").scalar()
    return margins.select("provider_id", (F.col("margin") - offset).alias("decision"))
