"""SQL that fits logit models on its own: Newton steps in a recursive query over the covariate patterns.

It shares nothing with ``kinpanel.stats.logit`` but the definition of the model, so it can check that module's results. A
state holds a model's coefficients as a list; a step builds the equations from the patterns and eliminates them in a fold.
Levels that are listed must occur, and no class may be separated.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

#: Newton steps from zero; far more than a well-behaved fit needs
STEPS = 14
#: 95 % points of the normal distribution and of chi-square with one degree of freedom
WALD, CUTOFF = 1.959963984540054, 3.841458820694124


def terms_of(xs: Sequence[str], levels: Mapping[str, Sequence]) -> list[tuple[str, str]]:
    """(term, SQL condition) of every level but the first."""
    return [(f"{x}{v}", f"CAST({x} AS VARCHAR) = '{v}'") for x in xs for v in levels[x][1:]]


def eliminated(matrix: str) -> str:
    """Gauss-Jordan over the rows of ``matrix`` (its leading square becomes the identity), as a fold over the pivots."""
    p = "CAST(p[1][1] AS INTEGER)"
    return f"""list_reduce(list_concat([{matrix}], list_transform({matrix}, lambda row, i: [[CAST(i AS DOUBLE)]])),
      lambda acc, p: list_transform(acc, lambda row, i: CASE WHEN i = {p} THEN list_transform(row, lambda v: v / row[{p}])
        ELSE list_transform(row, lambda v, c: v - row[{p}] * acc[{p}][c] / acc[{p}][{p}]) END))"""


_ETA = "list_transform(xs, lambda x: list_inner_product(x, beta))"
_DEVIANCE = "list_sum(list_transform(eta, lambda e, j: 2 * (ns[j] * (greatest(e, 0) + ln(1 + exp(-abs(e)))) - ss[j] * e)))"
_WEIGHTS = "list_transform(eta, lambda e, j: ns[j] / (1 + exp(-e)) / (1 + exp(e)))"
_RESTS = "list_transform(eta, lambda e, j: ss[j] - ns[j] / (1 + exp(-e)))"
_GRADIENT = "list_transform(xt, lambda col: list_sum(list_transform(col, lambda v, j: v * r[j])))"


def _information_row(col: str) -> str:
    return f"list_transform(xt, lambda other: list_sum(list_transform(other, lambda v, j: v * {col}[j] * w[j])))"


def fits(source: str, y: str, specs: Mapping[str, Sequence[tuple[str, str]]]) -> str:
    """CTEs ``models`` and ``fit`` (specification, beta, cov, error, deviance, nobs) for the terms of each specification."""
    rows = " UNION ALL ".join(
        f"SELECT '{name}' AS specification, [1.0::DOUBLE{''.join(f', CAST({c} AS INTEGER)::DOUBLE' for _, c in terms)}] AS x, {y} AS y FROM {source}"
        for name, terms in specs.items())
    return f"""
patterns AS (SELECT specification, x, CAST(count(*) AS DOUBLE) AS n, CAST(sum(y) AS DOUBLE) AS s FROM ({rows}) GROUP BY 1, 2),
flat AS (SELECT specification, list(x ORDER BY x) AS xs, list(n ORDER BY x) AS ns, list(s ORDER BY x) AS ss FROM patterns GROUP BY 1),
models AS (SELECT *, list_transform(xs[1], lambda v, a: list_transform(xs, lambda x: x[a])) AS xt FROM flat),
steps AS (
  SELECT specification, 0 AS i, list_transform(xs[1], lambda v: 0.0::DOUBLE) AS beta, CAST(NULL AS DOUBLE[][]) AS solved FROM models
  UNION ALL
  SELECT specification, i + 1, list_transform(beta, lambda b, a: b + solved[a][len(beta) + 1]), solved FROM (
    SELECT specification, i, beta, {eliminated('matrix')} AS solved FROM (
      SELECT specification, i, beta, list_transform(xt, lambda col, a: {_information_row('col')} || [gradient[a]]
                                                    || list_transform(xt, lambda other, b: CAST(a = b AS INTEGER)::DOUBLE)) AS matrix FROM (
        SELECT *, {_GRADIENT} AS gradient FROM (
          SELECT *, {_WEIGHTS} AS w, {_RESTS} AS r FROM (
            SELECT t.specification, t.i, t.beta, m.xs, m.xt, m.ns, m.ss, {_ETA} AS eta
            FROM steps t JOIN models m ON m.specification = t.specification WHERE t.i < {STEPS})))))),
fit AS (SELECT specification, beta, cov, list_transform(cov, lambda row, a: sqrt(row[a])) AS error, {_DEVIANCE} AS deviance,
               CAST(list_sum(ns) AS BIGINT) AS nobs
        FROM (SELECT t.specification, t.beta, list_transform(t.solved, lambda row: row[len(t.beta) + 2:]) AS cov, m.ns, m.ss, {_ETA} AS eta
              FROM steps t JOIN models m ON m.specification = t.specification WHERE t.i = {STEPS}))"""


def coefficients(specs: Mapping[str, Sequence[tuple[str, str]]]) -> str:
    """CTE ``coefficients``: a row per model and term with estimate, std_error, statistic and p_value (by a sum over the density)."""
    names = ", ".join(f"('{name}', ['(Intercept)'{''.join(f', $${t}$$' for t, _ in terms)}])" for name, terms in specs.items())
    return f"""
named AS (SELECT * FROM (VALUES {names}) v(specification, terms)),
coefficients AS (
  SELECT *, 1 - list_sum(list_transform(range(4000), lambda u: exp(-0.5 * (z * (u + 0.5) / 4000) ^ 2))) * z / 4000 * sqrt(2 / pi()) AS p_value
  FROM (SELECT *, estimate / std_error AS statistic, least(abs(estimate / std_error), 12) AS z
        FROM (SELECT specification, unnest(terms) AS term, CAST(unnest(range(len(terms))) AS INTEGER) AS position, unnest(beta) AS estimate,
                     unnest(error) AS std_error, nobs, deviance FROM fit JOIN named USING (specification))))"""


def limits(terms: Sequence[tuple[str, str]]) -> str:
    """CTE ``limits`` (term, side, value): where the deviance of the only model is ``CUTOFF`` above its minimum, profiled.

    Newton steps on: gradient zero in all other coefficients, deviance at the cutoff; the coefficient looked at stands last.
    """
    names = ", ".join(f"$${t}$$" for t, _ in terms)
    last = "list_transform(xt, lambda col, a: CASE WHEN a = len(xt) THEN gradient || [(deviance - lowest - " + str(CUTOFF) + ") / 2]"
    return f"""
looked AS (
  SELECT term, j, side, list_filter(range(1, len(beta) + 1), lambda q: q <> j) || [j] AS perm, beta, cov, error, deviance AS lowest, specification
  FROM (SELECT *, unnest([{names}]) AS term, unnest(range(2, len(beta) + 1)) AS j FROM fit), (SELECT unnest([-1, 1]) AS side)),
held AS (
  SELECT term, side, lowest, m.ns, m.ss, list_transform(m.xs, lambda x: list_transform(perm, lambda q: x[q])) AS xs,
         list_transform(perm, lambda q: m.xt[q]) AS xt,
         list_transform(perm, lambda q: beta[q] + cov[q][j] / cov[j][j] * side * sqrt({CUTOFF}) * error[j]) AS start
  FROM looked JOIN models m USING (specification)),
moves AS (
  SELECT term, side, 0 AS i, start AS beta FROM held
  UNION ALL
  SELECT term, side, i + 1, list_transform(beta, lambda b, a: b + solved[a][len(beta) + 1]) FROM (
    SELECT term, side, i, beta, {eliminated('matrix')} AS solved FROM (
      SELECT term, side, i, beta, {last} ELSE {_information_row('col')} || [gradient[a]] END) AS matrix FROM (
        SELECT *, {_GRADIENT} AS gradient FROM (
          SELECT *, {_WEIGHTS} AS w, {_RESTS} AS r, {_DEVIANCE} AS deviance FROM (
            SELECT t.term, t.side, t.i, t.beta, h.xs, h.xt, h.ns, h.ss, h.lowest, {_ETA} AS eta
            FROM moves t JOIN held h ON h.term = t.term AND h.side = t.side WHERE t.i < {STEPS})))))),
limits AS (SELECT term, side, beta[len(beta)] AS value FROM moves WHERE i = {STEPS})"""
