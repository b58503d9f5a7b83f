"""Dense logit fits of a small pattern table in one process: what the distributed fits are compared with."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd

from kinpanel.stats.logit import INTERCEPT, MAX_ITERATIONS, RUNAWAY_ERROR, Levels, deviance


def design(pdf: pd.DataFrame, xs: Sequence[str], levels: Levels) -> tuple[np.ndarray, list[str]]:
    """Indicator matrix with the first used level as baseline; a covariate with one used level adds no column."""
    columns, terms = [np.ones(len(pdf))], [INTERCEPT]
    for x in xs:
        values = pdf[x].to_numpy()
        used = [str(v) for v in levels[x] if (values == str(v)).any()]
        for level in used[1:]:
            columns.append((values == level).astype(float))
            terms.append(f"{x}{level}")
    return np.column_stack(columns), terms


def independent_columns(matrix: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Which columns are not a combination of earlier ones."""
    scaled = matrix * np.sqrt(weights)[:, None]
    keep, basis = [], np.zeros((len(scaled), 0))
    for j in range(scaled.shape[1]):
        column = scaled[:, j]
        rest = column - basis @ (basis.T @ column)
        rest = rest - basis @ (basis.T @ rest)
        size = np.linalg.norm(rest)
        good = size > 1e-7 * max(np.linalg.norm(column), 1e-12)
        keep.append(good)
        if good:
            basis = np.column_stack([basis, rest / size])
    return np.array(keep)


def solve_logit(matrix: np.ndarray, successes: np.ndarray, n: np.ndarray, offset: np.ndarray | float = 0.0,
                start: np.ndarray | None = None) -> dict:
    """Newton steps on pattern proportions from a zero start; steps are halved while the fit gets worse."""
    beta = np.zeros(matrix.shape[1]) if start is None else start.copy()
    eta = matrix @ beta + offset
    dev, done, steps = deviance(successes, n, eta), False, 0
    while steps < MAX_ITERATIONS and not done:
        steps += 1
        p = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
        info = matrix.T @ (matrix * (n * p * (1 - p))[:, None])
        move = np.linalg.lstsq(info, matrix.T @ (successes - n * p), rcond=None)[0]
        for _ in range(12):
            tried = matrix @ (beta + move) + offset
            tried_dev = deviance(successes, n, tried)
            if tried_dev <= dev * (1 + 1e-12) + 1e-12:
                break
            move = move / 2
        done = abs(dev - tried_dev) / (abs(tried_dev) + 0.1) < 1e-11
        beta, eta, dev = beta + move, tried, tried_dev
    p = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
    info = matrix.T @ (matrix * (n * p * (1 - p))[:, None])
    error = np.sqrt(np.clip(np.diag(np.linalg.pinv(info, hermitian=True)), 0, None)) if matrix.shape[1] else np.array([])
    separated = bool((error > RUNAWAY_ERROR).any() or (np.abs(beta) > 15).any())
    return {"beta": beta, "error": error, "deviance": dev, "p": p, "converged": done and not separated}


def score_split(train: np.ndarray, train_hits: np.ndarray, test: np.ndarray, test_hits: np.ndarray, pdf: pd.DataFrame,
                xs: Sequence[str], levels: Levels, event: int, threshold: float) -> dict[str, float]:
    """Fit on training counts, score test counts. Test rows with a level unseen in training are skipped and counted."""
    seen = train > 0
    known = np.ones(len(pdf), dtype=bool)
    used = {}
    for x in xs:
        values = pdf[x].to_numpy()
        used[x] = [str(v) for v in levels[x] if (values[seen] == str(v)).any()]
        known &= np.isin(values, used[x])
    rows = pdf[known]
    matrix, _ = design(rows, xs, used)
    fit_on = train[known] > 0
    keep = independent_columns(matrix[fit_on], train[known][fit_on].astype(float))
    fit = solve_logit(matrix[fit_on][:, keep], train_hits[known][fit_on].astype(float), train[known][fit_on].astype(float))
    eta = matrix[:, keep] @ fit["beta"]
    n, hits = test[known].astype(float), test_hits[known].astype(float)
    says_one = eta > np.log(threshold / (1 - threshold))
    is_event = (hits, n - hits) if event == 1 else (n - hits, hits)
    says_event = says_one if event == 1 else ~says_one
    caught, called = is_event[0][says_event].sum(), n[says_event].sum()
    correct = caught + is_event[1][~says_event].sum()
    order = np.argsort(eta, kind="stable")
    _, place = np.unique(np.round(eta[order], 12), return_inverse=True)
    pos, neg = np.bincount(place, hits[order]), np.bincount(place, (n - hits)[order])
    below = np.concatenate([[0.0], np.cumsum(neg)[:-1]]) + neg / 2

    def ratio(a: float, b: float) -> float:
        return float(a / b) if b > 0 else float("nan")

    return {"accuracy": ratio(correct, n.sum()), "precision": ratio(caught, called),
            "recall": ratio(caught, is_event[0].sum()), "roc_auc": ratio((pos * below).sum(), pos.sum() * neg.sum()),
            "skipped": float(test[~known].sum()), "scored": float(n.sum())}
