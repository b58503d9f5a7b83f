"""Logit models on categorical covariates.

``fit_specifications`` fits many models together: the data are reduced to covariate patterns on the cluster, and all
models take their Newton steps at once. For a step, one job, every task gives its part of each model's deviance, gradient
and information; only these sums (a few numbers per coefficient) reach the driver. So there is one solver, whatever the
size of the table. ``distributed_logit`` is the fit for a model
with numeric covariates.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinpanel.functions.special import normal_two_sided
from kinpanel.session import checkpointed
from kinpanel.stats.patterns import compress

MAX_ITERATIONS = 25
# Standard errors beyond this mark a coefficient that runs off to infinity (complete separation).
RUNAWAY_ERROR = 1000.0
INTERCEPT = "(Intercept)"
# Tasks that read the pattern table for a step.
TASKS = 32

Levels = Mapping[str, Sequence[object]]


def deviance(successes: np.ndarray, n: np.ndarray, eta: np.ndarray) -> float:
    """-2 log-likelihood of grouped binary data; log(1 + e^eta) form, so fitted 0 and 1 cause no infinities."""
    return float(2 * np.sum(successes * np.logaddexp(0, -eta) + (n - successes) * np.logaddexp(0, eta)))


FIT_COLUMNS = ("term string, position int, estimate double, std_error double, statistic double, p_value double, "
               "nobs long, deviance double, converged boolean")

# -------------------------------------------------------------------------------------- many models together


@dataclass(frozen=True)
class Design:
    """Columns of one model on one subgroup: the intercept and (covariate, level) indicators."""
    subgroup: str
    xs: tuple[str, ...]
    columns: tuple[tuple[str, str], ...]

    def matrix(self, pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """(which rows are in the model, their indicator matrix)"""
        rows = (pdf["subgroup"] == self.subgroup).to_numpy()
        for x in self.xs:
            rows &= pdf[x].notna().to_numpy()
        own = pdf[rows]
        return rows, np.column_stack([np.ones(len(own)), *[(own[x] == v).to_numpy(float) for x, v in self.columns]])


def packed_sums(dev: float, gradient: np.ndarray, info: np.ndarray) -> np.ndarray:
    """Deviance, gradient and the lower triangle of the information as one row of numbers."""
    return np.concatenate([[dev], gradient, info[np.tril_indices(len(gradient))]])


def unpacked_sums(total: np.ndarray, k: int) -> tuple[float, np.ndarray, np.ndarray]:
    info = np.zeros((k, k))
    info[np.tril_indices(k)] = total[1 + k:]
    return float(total[0]), total[1:1 + k], info + np.tril(info, -1).T


def parts_at(matrix: np.ndarray, s: np.ndarray, n: np.ndarray, beta: np.ndarray | None) -> np.ndarray:
    """The sums of some patterns at given coefficients; for None the cross products with weights n."""
    if beta is None:
        return packed_sums(0.0, np.zeros(matrix.shape[1]), matrix.T @ (matrix * n[:, None]))
    eta = matrix @ beta
    p = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
    return packed_sums(deviance(s, n, eta), matrix.T @ (s - n * p), matrix.T @ (matrix * (n * p * (1 - p))[:, None]))


def summed(patterns: DataFrame, sizes: Sequence[int], add: Callable[[pd.DataFrame, list[np.ndarray]], None]) -> list[np.ndarray]:
    """Sums over all patterns: ``add`` adds what a batch gives to every point's row of numbers.

    One job. Patterns are bounded by the product of the level counts, so ``TASKS`` tasks read them, and each sends one row
    per point: a bounded result, which the driver adds up.
    """
    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = [np.zeros(size) for size in sizes]
        for pdf in batches:
            add(pdf, sums)
        yield pd.DataFrame({"point": range(len(sums)), "sums": [t.tolist() for t in sums]})

    found = [np.zeros(size) for size in sizes]
    for r in patterns.coalesce(TASKS).mapInPandas(part, "point int, sums array<double>").collect():
        found[r["point"]] += np.array(r["sums"])
    return found


def evaluate(patterns: DataFrame, points: Sequence[tuple[Design, np.ndarray | None]]) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """(deviance, gradient, information) of each model at its coefficients; for None (0, 0, cross products with weights n)."""
    widths = [1 + len(d.columns) for d, _ in points]

    def add(pdf: pd.DataFrame, sums: list[np.ndarray]) -> None:
        known: dict[Design, tuple[np.ndarray, np.ndarray]] = {}
        counts, hits = pdf["n"].to_numpy(float), pdf["successes"].to_numpy(float)
        for total, (design_, beta) in zip(sums, points):
            if design_ not in known:
                known[design_] = design_.matrix(pdf)
            rows, matrix = known[design_]
            total += parts_at(matrix, hits[rows], counts[rows], beta)

    sizes = [1 + k + k * (k + 1) // 2 for k in widths]
    return [unpacked_sums(t, k) for t, k in zip(summed(patterns, sizes, add), widths)]


Steps = Generator[np.ndarray, tuple[float, np.ndarray, np.ndarray], dict]


def newton(start: np.ndarray, free: np.ndarray) -> Steps:
    """Newton steps over the ``free`` coefficients; asks for the sums at a point by yielding it.

    Steps are halved while the fit gets worse.
    """
    beta = start.copy()
    dev, gradient, info = yield beta
    done, steps = not free.any(), 0
    while steps < MAX_ITERATIONS and not done:
        steps += 1
        move = np.zeros(len(beta))
        move[free] = np.linalg.lstsq(info[np.ix_(free, free)], gradient[free], rcond=None)[0]
        for _ in range(12):
            tried = yield beta + move
            if tried[0] <= dev * (1 + 1e-12) + 1e-12:
                break
            move = move / 2
        done = abs(dev - tried[0]) / (abs(tried[0]) + 0.1) < 1e-11
        beta, (dev, gradient, info) = beta + move, tried
    error = np.sqrt(np.clip(np.diag(np.linalg.pinv(info, hermitian=True)), 0, None))
    separated = bool((error > RUNAWAY_ERROR).any() or (np.abs(beta) > 15).any())
    return {"beta": beta, "error": error, "deviance": dev, "information": info, "converged": done and not separated}


def run_together(patterns: DataFrame, tasks: Sequence[tuple[Design, Generator]], evaluate: Callable = evaluate) -> list:
    """Results of generators that ask for sums; all open requests of a round are one job."""
    out: list = [None] * len(tasks)
    asked: dict[int, np.ndarray] = {}

    def step(k: int, answer) -> None:
        try:
            asked[k] = tasks[k][1].send(answer)
        except StopIteration as end:
            out[k] = end.value

    for k in range(len(tasks)):
        step(k, None)
    while asked:
        now, points = list(asked), list(asked.values())
        asked.clear()
        for k, sums in zip(now, evaluate(patterns, [(tasks[k][0], p) for k, p in zip(now, points)])):
            step(k, sums)
    return out


def designs(patterns: DataFrame, wanted: Sequence[tuple[str, Sequence[str]]], levels: Levels
            ) -> list[tuple[Design, list[str], np.ndarray, int]]:
    """Per (subgroup, covariates): design of its independent columns, all its terms, which of them are kept, row count.

    The first used level of a covariate is its baseline; a covariate with one used level adds no column. Used levels and
    dependent columns are read off the cross products of all indicators, summed in one job.
    """
    full = [Design(g, tuple(xs), tuple((x, str(v)) for x in xs for v in levels[x])) for g, xs in wanted]
    out = []
    for whole, (_, _, gram) in zip(full, evaluate(patterns, [(d, None) for d in full])):
        used = [i for i, c in enumerate(whole.columns, 1) if gram[i, i] > 0]
        first = {x: next((i for i in used if whole.columns[i - 1][0] == x), None) for x in whole.xs}
        terms = [i for i in used if i != first[whole.columns[i - 1][0]]]
        at = [0, *terms]
        keep = np.array(_independent_from_gram(gram[np.ix_(at, at)]))
        kept = tuple(whole.columns[i - 1] for i, good in zip(terms, keep[1:]) if good)
        names = [INTERCEPT, *["".join(whole.columns[i - 1]) for i in terms]]
        out.append((Design(whole.subgroup, whole.xs, kept), names, keep, int(round(gram[0, 0]))))
    return out


def fit_specifications(df: DataFrame, y: str, specifications: Mapping[str, Sequence[str]], levels: Levels,
                       subgroups: Mapping[str, Column] | None = None, optional: Sequence[str] = ()) -> DataFrame:
    """Fit every specification on every subgroup: (subgroup, specification, term, estimate, …).

    Rows with a missing covariate are left out, aliased terms get NULLs; a model without complete rows has no rows.
    ``optional`` covariates are left out of the models of a subgroup in which they have a single value, a missing value
    counting as one.
    """
    specs = {k: list(dict.fromkeys(v)) for k, v in specifications.items()}
    used = {x: levels[x] for x in levels if any(x in xs for xs in specs.values())}
    subgroups = dict(subgroups or {"all": F.lit(True)})
    patterns = checkpointed(compress(df, y, used, subgroups))
    flat = {} if not optional else _single_valued(patterns, [x for x in optional if x in used])
    wanted = [(g, name, [x for x in xs if x not in flat.get(g, ())]) for g in subgroups for name, xs in specs.items()]
    models = designs(patterns, [(g, xs) for g, _, xs in wanted], used)
    live = [(w, m) for w, m in zip(wanted, models) if m[3]]
    fits = run_together(patterns, [(d, newton(np.zeros(1 + len(d.columns)), np.ones(1 + len(d.columns), dtype=bool)))
                                   for _, (d, *_) in live])
    out = []
    for ((g, name, _), (_, terms, keep, nobs)), fit in zip(live, fits):
        values = iter(zip(fit["beta"].tolist(), fit["error"].tolist()))
        for place, (term, good) in enumerate(zip(terms, keep)):
            b, e = next(values) if good else (None, None)
            z = b / e if good and e else None
            out.append((g, name, term, place, b, e, z, None if z is None else normal_two_sided(z), nobs, fit["deviance"], fit["converged"]))
    return df.sparkSession.createDataFrame(out, f"subgroup string, specification string, {FIT_COLUMNS}")


def _single_valued(patterns: DataFrame, names: Sequence[str]) -> dict[str, set[str]]:
    """Per subgroup the covariates that have one value there, a missing value counting as one."""
    flags = [((F.coalesce(F.min(x) == F.max(x), F.lit(True))) & (F.count(x).isin(0) | (F.count(x) == F.count("*")))).alias(x) for x in names]
    rows = patterns.groupBy("subgroup").agg(F.count("*").alias("__n"), *flags).collect()
    return {r["subgroup"]: {x for x in names if r[x]} for r in rows}


def profile_intervals(df: DataFrame, y: str, xs: Sequence[str], levels: Levels, cutoff: float = 3.841458820694124) -> DataFrame:
    """Odds ratios with Wald and profile-likelihood limits: (term, odds_ratio, wald_low, wald_high, low, high).

    ``cutoff`` is the 95 % point of a chi-square with one degree of freedom. All limits are looked for together, one job a
    step: Newton steps on the equations that hold at a limit. A limit is NULL if the likelihood never falls that far.
    """
    xs = list(xs)
    used = {x: levels[x] for x in xs}
    schema = "term string, odds_ratio double, wald_low double, wald_high double, low double, high double"
    patterns = checkpointed(compress(df, y, used, {"all": F.lit(True)}))
    design_, terms, keep, nobs = designs(patterns, [("all", xs)], used)[0]
    if not nobs:
        return df.sparkSession.createDataFrame([], schema)
    k = 1 + len(design_.columns)
    best = run_together(patterns, [(design_, newton(np.zeros(k), np.ones(k, dtype=bool)))])[0]
    looked = [(j, side) for j in range(1, k) for side in (-1, 1)]
    limits = dict(zip(looked, run_together(patterns, [(design_, profile_point(best, j, side, cutoff)) for j, side in looked])))
    names = [t for t, good in zip(terms, keep) if good]
    out = []
    for j in range(1, k):
        b, e = float(best["beta"][j]), float(best["error"][j])
        ends = [None if v is None else float(np.exp(v)) for v in (limits[j, -1], limits[j, 1])]
        with np.errstate(over="ignore"):  # infinite for a separated class
            wald = [float(np.exp(b + d * WALD * e)) for d in (-1, 1)]
        out.append((names[j], float(np.exp(b)), *wald, *ends))
    return df.sparkSession.createDataFrame(out, schema)


def limit_excess(df: DataFrame, y: str, xs: Sequence[str], levels: Levels, limits: DataFrame) -> DataFrame:
    """(term, side, excess): deviance with the coefficient held at a profile limit, less the smallest deviance.

    The limits come from ``profile_intervals``; every held fit starts from zero, apart from the search that found them.
    """
    xs = list(xs)
    patterns = checkpointed(compress(df, y, {x: levels[x] for x in xs}, {"all": F.lit(True)}))
    design_, terms, keep, nobs = designs(patterns, [("all", xs)], levels)[0]
    k = 1 + len(design_.columns)
    names, every = [t for t, good in zip(terms, keep) if good], np.ones(k, dtype=bool)
    held = [(r["term"], side, names.index(r["term"]), float(np.log(r[side])))
            for r in limits.collect() for side in ("low", "high") if r[side] is not None]
    tasks = [(design_, newton(np.zeros(k), every))]
    for _, _, j, value in held:
        start, free = np.zeros(k), every.copy()
        start[j], free[j] = value, False
        tasks.append((design_, newton(start, free)))
    best, *others = run_together(patterns, tasks)
    return df.sparkSession.createDataFrame(
        [(term, side, fit["deviance"] - best["deviance"]) for (term, side, *_), fit in zip(held, others)],
        "term string, side string, excess double")


WALD = 1.959963984540054
# Coefficients beyond this are not looked at as limits.
FARTHEST = 30.0


def profile_point(best: dict, j: int, side: int, cutoff: float) -> Generator:
    """The limit of coefficient ``j``: deviance ``cutoff`` above its minimum, gradient zero in all other coefficients.

    Newton steps on these equations, from where the quadratic form at the minimum puts the limit. If they do not settle on
    the right side, the limit is bracketed instead (``profile_limit``).
    """
    cov = np.linalg.pinv(best["information"], hermitian=True)
    centre, error = float(best["beta"][j]), float(best["error"][j])
    if not 0 < error < RUNAWAY_ERROR:
        return (yield from profile_limit(best, j, side, cutoff))
    beta = best["beta"] + cov[:, j] / cov[j, j] * side * np.sqrt(cutoff) * error
    for _ in range(15):
        dev, gradient, info = yield beta
        gap = dev - best["deviance"] - cutoff
        rows, right = info.copy(), gradient.copy()
        rows[j], right[j] = gradient, gap / 2
        move = np.linalg.lstsq(rows, right, rcond=None)[0]
        move *= min(1.0, 2 * error / max(abs(move[j]), 1e-300))
        beta = beta + move
        if side * (beta[j] - centre) <= 0 or not np.isfinite(beta).all():
            break
        if abs(gap) < 1e-6 and np.abs(move).max() < 1e-7 * max(1.0, np.abs(beta).max()):
            return float(beta[j])
    return (yield from profile_limit(best, j, side, cutoff))


def profile_limit(best: dict, j: int, side: int, cutoff: float) -> Generator:
    """Where the deviance is ``cutoff`` above its minimum on one side of coefficient ``j``; None if it never gets there."""
    free = np.ones(len(best["beta"]), dtype=bool)
    free[j] = False
    centre, step, goal = float(best["beta"][j]), side * float(best["error"][j]), np.sqrt(cutoff)
    last = best["beta"]

    def root(value: float) -> Generator:
        nonlocal last
        start = last.copy()
        start[j] = value
        found = yield from newton(start, free)
        last = found["beta"]
        return np.sqrt(max(found["deviance"] - best["deviance"], 0.0)) - goal

    inner, low = centre, -goal
    outer = centre + 2 * step
    while True:
        # beyond FARTHEST every share is 0 or 1 to the last digit
        outer = side * min(side * outer, FARTHEST)
        if side * (outer - inner) <= 0:
            return None
        high = yield from root(outer)
        if high > 0:
            break
        inner, low, outer = outer, high, outer + 2 * (outer - centre)
    for _ in range(60):
        # false position, with the middle where it stalls
        guess = inner + (outer - inner) * (-low / (high - low))
        at = yield from root(guess)
        if abs(at) < 1e-10 or abs(outer - inner) < 1e-10 * max(1.0, abs(outer)):
            return guess
        if at > 0:
            stalled, outer, high = abs(outer - guess) < 1e-3 * abs(outer - inner), guess, at
        else:
            stalled, inner, low = abs(inner - guess) < 1e-3 * abs(outer - inner), guess, at
        if stalled and abs(outer - inner) > 1e-8 * max(1.0, abs(outer)):
            middle = (inner + outer) / 2
            at = yield from root(middle)
            if at > 0:
                outer, high = middle, at
            else:
                inner, low = middle, at
    return (inner + outer) / 2


# ---------------------------------------------------------------------------------------- distributed fit


def distributed_logit(df: DataFrame, y: str, xs: Sequence[str], levels: Levels) -> DataFrame:
    """One model through Spark's own iteratively reweighted fit, with the columns of ``fit_specifications``.

    Covariates with a level list become indicators; others enter as numbers. If all are categorical the rows are first
    reduced to pattern *proportions* with the count as weight. (0/1 rows with counts as weights make Spark's start values
    diverge.)
    """
    clean = df.filter(F.col(y).isNotNull()).dropna(subset=list(xs))
    outcome = F.col(y).cast("double")
    if all(x in levels for x in xs):
        rows = clean.groupBy(*xs).agg(F.avg(outcome).alias("__p"), F.count(F.lit(1)).alias("__n"))
    else:
        rows = clean.select(*xs, outcome.alias("__p"), F.lit(1).alias("__n"))
    return fit_proportions(rows, xs, levels)


def fit_proportions(rows: DataFrame, xs: Sequence[str], levels: Levels) -> DataFrame:
    """Fit on rows of covariates, ``__p`` (share of successes) and ``__n`` (weight).

    Aliased terms are found on the cross-product matrix, left out and reported with NULLs.
    """
    categorical = [x for x in xs if x in levels]
    for x in categorical:
        rows = rows.filter(F.col(x).cast("string").isin([str(v) for v in levels[x]]))
    rows = rows.persist()
    try:
        seen = rows.agg(F.sum("__n").alias("n"), *[F.collect_set(F.col(x).cast("string")).alias(x) for x in categorical]).first()
        terms: dict[str, Column] = {}
        for x in xs:
            if x not in levels:
                terms[x] = F.col(x).cast("double")
                continue
            for level in [str(v) for v in levels[x] if str(v) in seen[x]][1:]:
                terms[f"{x}{level}"] = (F.col(x).cast("string") == level).cast("double")
        names = list(terms)
        flat = rows.select("__p", F.col("__n").cast("double").alias("__n"),
                           *[c.alias(f"x{i}") for i, c in enumerate(terms.values())])
        keep = [i for i, good in enumerate(_independent_from_gram(_cross_products(flat, len(names)))[1:]) if good]
        if not keep:
            return _intercept_only(rows, names, int(seen["n"] or 0))
        ready = VectorAssembler(inputCols=[f"x{i}" for i in keep], outputCol="features").transform(flat)
        model = GeneralizedLinearRegression(
            family="binomial", link="logit", labelCol="__p", weightCol="__n", linkPredictionCol="__eta", tol=1e-10,
            maxIter=MAX_ITERATIONS).fit(ready)
        summary = model.summary
        # slopes first, intercept last
        values = dict(zip([*[names[i] for i in keep], INTERCEPT], zip(
            [*model.coefficients.toArray().tolist(), model.intercept], summary.coefficientStandardErrors,
            summary.tValues, summary.pValues)))
        # the summary's own deviance is relative to the patterns
        eta, share = F.col("__eta"), F.col("__p")
        loss = 2 * F.col("__n") * (F.greatest(eta, F.lit(0.0)) + F.log1p(F.exp(-F.abs(eta))) - share * eta)
        total = model.transform(ready).agg(F.sum(loss)).first()[0]
        ended = summary.numIterations < MAX_ITERATIONS and max(v[1] for v in values.values()) <= RUNAWAY_ERROR and max(
            abs(v[0]) for v in values.values()) <= 15
        out = [(t, i, *([float(v) for v in values.get(t, ())] or [None] * 4), int(seen["n"]), float(total), bool(ended))
               for i, t in enumerate([INTERCEPT, *names])]
        return rows.sparkSession.createDataFrame(out, FIT_COLUMNS)
    finally:
        rows.unpersist()


def _intercept_only(rows: DataFrame, names: Sequence[str], nobs: int) -> DataFrame:
    """The fit without any usable term: the log odds of the share of successes; no rows without data."""
    share = rows.agg(F.sum(F.col("__p") * F.col("__n")) / F.sum("__n")).first()[0]
    out = []
    if nobs:
        inside = 0 < share < 1
        b = float(np.log(share / (1 - share))) if inside else float(np.sign(share - 0.5) * np.inf)
        e = float(1 / np.sqrt(nobs * share * (1 - share))) if inside else None
        dev = float(-2 * nobs * (share * np.log(share) + (1 - share) * np.log(1 - share))) if inside else 0.0
        z = b / e if e else None
        out.append((INTERCEPT, 0, b, e, z, None if z is None else normal_two_sided(z), nobs, dev, inside))
        out += [(t, i + 1, None, None, None, None, nobs, dev, inside) for i, t in enumerate(names)]
    return rows.sparkSession.createDataFrame(out, FIT_COLUMNS)


def _cross_products(flat: DataFrame, k: int) -> np.ndarray:
    """Weighted cross-product matrix of intercept and terms: one aggregate, k x k numbers."""
    columns = [F.lit(1.0), *[F.col(f"x{i}") for i in range(k)]]
    sums = [F.sum(columns[i] * columns[j] * F.col("__n")).alias(f"g{i}_{j}") for i in range(k + 1) for j in range(i, k + 1)]
    row = flat.agg(*sums).first()
    gram = np.zeros((k + 1, k + 1))
    for i in range(k + 1):
        for j in range(i, k + 1):
            gram[i, j] = gram[j, i] = row[f"g{i}_{j}"]
    return gram


def _independent_from_gram(gram: np.ndarray) -> list[bool]:
    """Columns whose squared length is not used up by earlier ones (elimination in order)."""
    left, keep = gram.copy(), []
    for j in range(len(left)):
        good = left[j, j] > 1e-10 * max(gram[j, j], 1e-300)
        keep.append(bool(good))
        if good:
            left = left - np.outer(left[:, j], left[j, :]) / left[j, j]
    return keep


def score_check(df: DataFrame, y: str, xs: Sequence[str], levels: Levels, fitted: DataFrame) -> DataFrame:
    """Score equation sum of x * (y - p) per term, which a correct fit makes zero; summed over all rows on the cluster."""
    estimates = {r["term"]: r["estimate"] for r in fitted.select("term", "estimate").collect()}
    clean = df.filter(F.col(y).isNotNull()).dropna(subset=list(xs))
    indicators = {INTERCEPT: F.lit(1.0)}
    for x in xs:
        for level in levels[x]:
            if f"{x}{level}" in estimates:
                indicators[f"{x}{level}"] = (F.col(x).cast("string") == str(level)).cast("double")
    eta = sum((F.lit(estimates[t] or 0.0) * c for t, c in indicators.items()), F.lit(0.0))
    rows = clean.withColumn("__r", F.col(y).cast("double") - F.lit(1.0) / (F.lit(1.0) + F.exp(-eta)))
    return rows.agg(*[F.sum(c * F.col("__r")).alias(t) for t, c in indicators.items()]).unpivot(
        [], [F.col(f"`{t}`") for t in indicators], "term", "score")
