"""Hyper-parameter search (H1-H6) over the reference's grids.

Every candidate is scored by k-fold CV on the fold column of the cached
training frame. The linear family needs one pass for its whole grid (see
``plans/gram.py``); other candidates are fitted concurrently from a thread pool
(Spark runs the jobs side by side, like ``CrossValidator(parallelism=...)``)."""

from __future__ import annotations

import itertools
import logging
import random
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame

from regressa import messages as M
from regressa.operators.metrics import LOWER_IS_BETTER
from regressa.plans import gram

log = logging.getLogger(__name__)

# The reference's search grids, per model, in its order.
PARAM_GRIDS = {
    "random_forest": {
        "n_estimators": [50, 100, 200, 300],
        "max_depth": [3, 5, 10, None],
        "min_samples_split": [2, 5, 10],
        "min_samples_leaf": [1, 2, 4],
        "max_features": ["sqrt", "log2", None],
    },
    "gradient_boosting": {
        "n_estimators": [50, 100, 200],
        "learning_rate": [0.01, 0.1, 0.2],
        "max_depth": [3, 5, 7],
        "min_samples_split": [2, 5, 10],
        "subsample": [0.8, 0.9, 1.0],
    },
    "ridge": {"alpha": [0.1, 1.0, 10.0, 100.0, 1000.0]},
    "lasso": {"alpha": [0.1, 1.0, 10.0, 100.0, 1000.0]},
    "elastic_net": {"alpha": [0.1, 1.0, 10.0, 100.0], "l1_ratio": [0.1, 0.3, 0.5, 0.7, 0.9]},
    "svr": {"C": [0.1, 1, 10, 100], "epsilon": [0.01, 0.1, 0.2], "kernel": ["linear", "rbf"]},
}
# Fixed value: minimum R2 gain for the tuned model to replace the original.
MIN_IMPROVEMENT = 0.001
# Spark ML's boosting has no ``min_samples_split``; candidates differing only in
# it are identical fits, so the search collapses them.
UNSUPPORTED = {"gradient_boosting": {"min_samples_split"}}


def candidates(model: str, method: str = "random", n_iter: int = 50, seed: int = 42) -> list:
    """H1 grid (every combination) or H2 random search (seeded sample without
    replacement, capped at the grid size). Any method other than 'grid'
    ('bayesian' included, H3) runs as random search."""
    grid = PARAM_GRIDS.get(model)
    if not grid:
        return []
    keys = list(grid)
    # Candidates that would be the same fit are merged before sampling, so a
    # random search evaluates ``n_iter`` different ones.
    merged = {}
    for v in itertools.product(*[grid[k] for k in keys]):
        c = dict(zip(keys, v))
        merged.setdefault(tuple((k, c[k]) for k in keys if k not in UNSUPPORTED.get(model, ())), c)
    combos = list(merged.values())
    if method == "grid":
        return combos
    if method != "random":
        log.warning(M.NOTE_RANDOM_INSTEAD.format(method=method))
    return random.Random(seed).sample(combos, min(n_iter, len(combos)))


def from_moments(train: DataFrame, feature_names, metric: str) -> bool:
    """Whether the linear family is solved from sums of products: plain features, few enough, and
    a metric that squared errors give."""
    plain = not any(isinstance(train.schema[c].dataType, VectorUDT)
                    for c in feature_names if c in train.columns)
    return plain and 0 < len(feature_names) <= gram.MAX_FEATURES and metric in gram.METRICS


def _moments(train: DataFrame, feature_names, fold_col: str = "fold") -> dict:
    from regressa.plans import models

    known = all(c in train.columns for c in feature_names)
    return gram.fold_moments(train, list(feature_names) if known else models.FEATURES, models.LABEL,
                             len(feature_names), fold_col)


def cross_val_scores(name: str, train: DataFrame, feature_names, hp: dict, k: int,
                     metric: str = "r2", seed: int = 42, fold_col: str = "fold",
                     parallelism: int | None = None) -> list[float]:
    """A1: fit on k-1 folds, score the held-out fold; k scores. The k fits are
    submitted concurrently; the held-out predictions of all folds are scored
    in one grouped aggregation. The linear family is solved from one pass."""
    if name in gram.FAMILY and from_moments(train, feature_names, metric):
        return gram.cross_val_scores(_moments(train, feature_names, fold_col), name, hp, metric)
    from regressa.operators.metrics import cv_score_frame
    from regressa.plans.models import fit_model

    def fit_fold(f):
        fit = fit_model(name, train.where(train[fold_col] != f), feature_names, hp, seed)
        return fit.predict(train.where(train[fold_col] == f))

    with ThreadPoolExecutor(max_workers=max(1, parallelism or k)) as pool:
        parts = list(pool.map(fit_fold, range(k)))
    preds = parts[0]
    for p in parts[1:]:
        preds = preds.unionByName(p)
    rows = cv_score_frame(preds, metric, fold=fold_col).orderBy(fold_col).collect()
    return [r["score"] for r in rows]


def search(name: str, train: DataFrame, feature_names, k: int, method: str = "random",
           n_iter: int = 50, seed: int = 42, metric: str = "r2", parallelism: int = 4):
    """H6: ``(best_params, best_score, results)``; ``results`` rows are
    ``(params, mean_score, std_score)`` for every candidate."""
    import numpy as np

    cands = candidates(name, method, n_iter, seed)
    if not cands:
        return {}, None, []

    one_pass = name in gram.FAMILY and from_moments(train, feature_names, metric)
    folds = _moments(train, feature_names) if one_pass else None

    def run(hp):
        s = (gram.cross_val_scores(folds, name, hp, metric) if one_pass else
             cross_val_scores(name, train, feature_names, hp, k, metric, seed))
        return hp, float(np.mean(s)), float(np.std(s))

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        results = list(pool.map(run, cands))
    # Plain errors are better when smaller; scores and ``neg_`` errors when larger.
    sign = -1.0 if metric in LOWER_IS_BETTER else 1.0
    best = max(results, key=lambda r: sign * r[1])
    return best[0], best[1], results


def accept(original_r2: float | None, tuned_r2: float | None) -> bool:
    """H5: the tuned model wins only by more than 0.001 test R2."""
    if original_r2 is None or tuned_r2 is None:
        return False
    return tuned_r2 - original_r2 > MIN_IMPROVEMENT
