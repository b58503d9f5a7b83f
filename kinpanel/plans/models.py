"""Statistics on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinpanel.functions import expressions as E
from kinpanel.operators.scale import salted_join
from kinpanel.operators.reshape import stacked
from kinpanel.plans import logit_sql
from kinpanel.plans.registry import query, table
from kinpanel.session import checkpointed
from kinpanel.stats import crosstab as C
from kinpanel.stats import holdout as S
from kinpanel.stats import logit as L
from kinpanel.stats import metrics as M
from kinpanel.stats.specs import coefficient_table as make_table
from kinpanel.stats.specs import nested_specifications as nest
from kinpanel.stats.specs import varying_columns as varying

BANDS = ["low", "middle", "high"]
LINE_LEVELS = {"l_linestatus": ["F", "O"], "band": BANDS}
JOINED_LEVELS = {**LINE_LEVELS, "o_orderstatus": ["F", "O", "P"],
                 "priority": ["1", "2", "3", "4", "5"], "late": [0, 1]}
# A plain name adds one covariate, a list adds several together, a mapping tries alternatives and keeps the last.
GROUPS = {"line_status": "l_linestatus", "quantity": "band",
          "order": {"order_status": "o_orderstatus", "order_priority": "priority"}, "late": "late"}


PROFILED = ["l_linestatus", "band", "o_orderstatus", "late"]


def quantity_band():
    return E.choose([(F.col("l_quantity") < 17, "low"), (F.col("l_quantity") < 34, "middle")], "high")


def lines(spark, sf) -> DataFrame:
    """Lines with a returned flag and a quantity class."""
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linestatus", "l_returnflag", "l_quantity", "l_extendedprice", "l_discount",
        F.year("l_shipdate").alias("year"), (F.col("l_returnflag") == "R").cast("int").alias("returned"),
        quantity_band().alias("band"))


def lines_with_orders(spark, sf) -> DataFrame:
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus", F.substring("o_orderpriority", 1, 1).alias("priority"),
        (F.year("o_orderdate") >= 1998).cast("int").alias("late"))
    # an order has few lines
    return salted_join(lines(spark, sf).select("l_orderkey", "l_linestatus", "returned", "band"), orders, ["l_orderkey"], check=False)


_LINES = """
WITH l AS (SELECT *, CAST(year(l_shipdate) AS INTEGER) AS y, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS r,
                  CASE WHEN l_quantity < 17 THEN 'low' WHEN l_quantity < 34 THEN 'middle' ELSE 'high' END AS band
           FROM lineitem)
"""


# ------------------------------------------------------------------------------------------------- logit


@query("logit_single", _LINES + """,
c AS (SELECT l_linestatus AS x, sum(r) AS s, count(*) - sum(r) AS f FROM l GROUP BY 1),
b AS (SELECT s, f FROM c WHERE x = 'F'), o AS (SELECT s, f FROM c WHERE x = 'O')
SELECT '(Intercept)' AS term, round(ln(b.s / b.f), 6) AS estimate, round(sqrt(1 / b.s + 1 / b.f), 6) AS std_error,
       (SELECT count(*) FROM l) AS nobs FROM b
UNION ALL SELECT 'l_linestatusO', round(ln(o.s / o.f) - ln(b.s / b.f), 6),
       round(sqrt(1 / b.s + 1 / b.f + 1 / o.s + 1 / o.f), 6), (SELECT count(*) FROM l) FROM b, o""")
def logit_single(spark, sf):
    """Spark's distributed fit of one factor against its closed form."""
    fit = L.distributed_logit(lines(spark, sf), "returned", ["l_linestatus"], LINE_LEVELS)
    return fit.select("term", F.round("estimate", 6).alias("estimate"), F.round("std_error", 6).alias("std_error"), "nobs")


@query("odds_ratios", _LINES + """,
c AS (SELECT band AS x, sum(r) AS s, count(*) - sum(r) AS f FROM l GROUP BY 1), b AS (SELECT s, f FROM c WHERE x = 'low'),
e AS (SELECT 'band' || x AS term, ln(c.s / c.f) - ln(b.s / b.f) AS est, sqrt(1 / b.s + 1 / b.f + 1 / c.s + 1 / c.f) AS se
      FROM c, b WHERE x <> 'low')
SELECT term, round(exp(est), 6) AS odds_ratio, round(exp(est - 1.959963984540054 * se), 6) AS low,
       round(exp(est + 1.959963984540054 * se), 6) AS high FROM e""")
def odds_ratios(spark, sf):
    fit = L.fit_specifications(lines(spark, sf), "returned", {"band": ["band"]}, LINE_LEVELS)
    side = L.WALD * F.col("std_error")
    return fit.filter(F.col("term") != L.INTERCEPT).select(
        "term", F.round(F.exp("estimate"), 6).alias("odds_ratio"),
        F.round(F.exp(F.col("estimate") - side), 6).alias("low"), F.round(F.exp(F.col("estimate") + side), 6).alias("high"))


@query("logit_by_subgroup", _LINES + """,
g AS (SELECT 'all' AS subgroup, l_linestatus, r FROM l UNION ALL SELECT 'early', l_linestatus, r FROM l WHERE y < 1998
      UNION ALL SELECT 'large', l_linestatus, r FROM l WHERE l_quantity >= 25),
c AS (SELECT subgroup, l_linestatus AS x, sum(r) AS s, count(*) - sum(r) AS f FROM g GROUP BY 1, 2)
SELECT b.subgroup, round(ln(o.s / o.f) - ln(b.s / b.f), 6) AS estimate,
       round(sqrt(1 / b.s + 1 / b.f + 1 / o.s + 1 / o.f), 6) AS std_error, CAST(b.s + b.f + o.s + o.f AS BIGINT) AS nobs
FROM c b JOIN c o ON o.subgroup = b.subgroup AND b.x = 'F' AND o.x = 'O'""")
def logit_by_subgroup(spark, sf):
    subgroups = {"all": F.lit(True), "early": F.col("year") < 1998, "large": F.col("l_quantity") >= 25}
    fit = L.fit_specifications(lines(spark, sf), "returned", {"status": ["l_linestatus"]}, LINE_LEVELS, subgroups)
    return fit.filter(F.col("term") == "l_linestatusO").select(
        "subgroup", F.round("estimate", 6).alias("estimate"), F.round("std_error", 6).alias("std_error"), "nobs")


def nested_fit(spark, sf) -> DataFrame:
    return L.fit_specifications(lines_with_orders(spark, sf), "returned", nest(GROUPS), JOINED_LEVELS)


_NESTED_TERMS = {name: logit_sql.terms_of(xs, JOINED_LEVELS) for name, xs in nest(GROUPS).items()}
_JOINED = """WITH RECURSIVE j AS (
  SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS r, l_linestatus, o_orderstatus, substr(o_orderpriority, 1, 1) AS priority,
         CASE WHEN l_quantity < 17 THEN 'low' WHEN l_quantity < 34 THEN 'middle' ELSE 'high' END AS band,
         CAST(year(o_orderdate) >= 1998 AS INTEGER) AS late
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),"""
_NESTED = _JOINED + logit_sql.fits("j", "r", _NESTED_TERMS) + "," + logit_sql.coefficients(_NESTED_TERMS)
_SHOWN = ["l_linestatus", "band", "o_orderstatus"]


# Sums over the rows agree to the last few digits only, so results are rounded.
@query("nested_specifications", _NESTED + """
SELECT 'all' AS subgroup, specification, term, position, round(estimate, 6) AS estimate, round(std_error, 6) AS std_error,
       round(statistic, 4) AS statistic, round(p_value, 6) AS p_value, nobs, round(deviance, 3) AS deviance, true AS converged
FROM coefficients""")
def nested_specifications(spark, sf):
    digits = {"estimate": 6, "std_error": 6, "statistic": 4, "p_value": 6, "deviance": 3}
    return nested_fit(spark, sf).withColumns({c: F.round(c, n) for c, n in digits.items()})


@query("coefficient_table", _NESTED + """,
texts AS (
  SELECT term, specification, regexp_replace(CAST(round(estimate, 3) AS VARCHAR), '\\.0$', '') || ' ('
         || regexp_replace(CAST(round(std_error, 3) AS VARCHAR), '\\.0$', '') || ')'
         || CASE WHEN p_value < 0.001 THEN '***' WHEN p_value < 0.01 THEN '**' WHEN p_value < 0.05 THEN '*' ELSE '' END AS text
  FROM coefficients WHERE regexp_matches(term, '""" + "|".join(_SHOWN) + """')
  UNION ALL SELECT 'nobs', specification, CAST(nobs AS VARCHAR) FROM fit)
SELECT 'all' AS subgroup, term""" + "".join(
    f""", max(text) FILTER (specification = '{name}') AS "+{name.replace('_', ' ')}\"""" for name in _NESTED_TERMS) + """
FROM texts GROUP BY term""")
def coefficient_table(spark, sf):
    return make_table(nested_fit(spark, sf), _SHOWN, list(nest(GROUPS)))


_PROFILED = {"all": logit_sql.terms_of(PROFILED, JOINED_LEVELS)}


@query("profile_intervals", _JOINED + logit_sql.fits("j", "r", _PROFILED) + "," + logit_sql.limits(_PROFILED["all"]) + f""",
sides AS (SELECT term, max(value) FILTER (side = -1) AS low, max(value) FILTER (side = 1) AS high FROM limits GROUP BY term),
ends AS (SELECT DISTINCT term, beta[j] AS b, error[j] AS e FROM looked)
SELECT term, round(exp(b), 6) AS odds_ratio, round(exp(b - {logit_sql.WALD} * e), 6) AS wald_low,
       round(exp(b + {logit_sql.WALD} * e), 6) AS wald_high, round(exp(low), 6) AS low, round(exp(high), 6) AS high
FROM ends JOIN sides USING (term)""")
def profile_intervals(spark, sf):
    found = L.profile_intervals(lines_with_orders(spark, sf), "returned", PROFILED, JOINED_LEVELS)
    return found.select("term", *[F.round(c, 6).alias(c) for c in found.columns if c != "term"])


@query("logit_score_check", """
SELECT term, CAST(0 AS DOUBLE) AS score FROM (
  SELECT DISTINCT '(Intercept)' AS term FROM lineitem
  UNION SELECT DISTINCT 'l_linestatus' || l_linestatus FROM lineitem WHERE l_linestatus <> 'F'
  UNION SELECT DISTINCT 'o_orderstatus' || o_orderstatus FROM orders WHERE o_orderstatus <> 'F')""")
def logit_score_check(spark, sf):
    """The score equations of a two-factor fit, summed over all rows: every sum must be zero."""
    xs, rows = ["l_linestatus", "o_orderstatus"], lines_with_orders(spark, sf)
    fit = L.distributed_logit(rows, "returned", xs, JOINED_LEVELS)
    check = L.score_check(rows, "returned", xs, JOINED_LEVELS, fit)
    return check.select("term", (F.round("score", 3) + F.lit(0.0)).alias("score"))


def worst_scores(rows: DataFrame, y: str, specs: dict[str, list[str]], levels: dict, fitted: DataFrame) -> DataFrame:
    """(specification, nobs, terms, score): the largest score sum of each fit per row, from the rows themselves."""
    fitted, parts = checkpointed(fitted), {}
    for name, xs in specs.items():
        own = fitted.filter(F.col("specification") == name)
        sums = L.score_check(rows, y, xs, levels, own.filter(F.col("estimate").isNotNull()))
        size = own.agg(F.max("nobs").alias("nobs"), F.count("estimate").alias("terms"))
        worst = sums.agg(F.max(F.abs("score")).alias("worst")).crossJoin(size)  # one row each
        parts[name] = worst.select("nobs", "terms", (F.round(F.col("worst") / F.col("nobs"), 6) + F.lit(0.0)).alias("score"))
    return stacked(parts, "specification")


@query("nested_scores", """
WITH j AS (SELECT *, CASE WHEN l_quantity < 17 THEN 'low' WHEN l_quantity < 34 THEN 'middle' ELSE 'high' END AS band,
                  substr(o_orderpriority, 1, 1) AS priority, year(o_orderdate) >= 1998 AS late
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
n AS (SELECT count(*) AS nobs, count(DISTINCT l_linestatus) - 1 AS a, count(DISTINCT band) - 1 AS b,
             count(DISTINCT o_orderstatus) - 1 AS c, count(DISTINCT priority) - 1 AS d, count(DISTINCT late) - 1 AS e FROM j)
SELECT unnest(['line_status', 'quantity', 'order_status', 'order_priority', 'late']) AS specification, nobs,
       unnest([1 + a, 1 + a + b, 1 + a + b + c, 1 + a + b + d, 1 + a + b + d + e]) AS terms, CAST(0 AS DOUBLE) AS score FROM n""")
def nested_scores(spark, sf):
    """The score equations of all nested fits: with them ``nested_specifications`` and ``coefficient_table`` are right."""
    rows = checkpointed(lines_with_orders(spark, sf))
    fitted = L.fit_specifications(rows, "returned", nest(GROUPS), JOINED_LEVELS)
    return worst_scores(rows, "returned", nest(GROUPS), JOINED_LEVELS, fitted)


@query("profile_excess", """
SELECT term, side, 3.8415::DOUBLE AS excess FROM (
  SELECT DISTINCT 'l_linestatus' || l_linestatus AS term FROM lineitem WHERE l_linestatus <> 'F'
  UNION SELECT unnest(['bandmiddle', 'bandhigh', 'late1'])
  UNION SELECT DISTINCT 'o_orderstatus' || o_orderstatus FROM orders WHERE o_orderstatus <> 'F'), (SELECT unnest(['low', 'high']) AS side)""")
def profile_excess(spark, sf):
    """How far -2 log-likelihood, summed over the patterns, lies above its minimum at the limits of ``profile_intervals``."""
    rows = checkpointed(lines_with_orders(spark, sf))
    limits = L.profile_intervals(rows, "returned", PROFILED, JOINED_LEVELS)
    return L.limit_excess(rows, "returned", PROFILED, JOINED_LEVELS, limits).withColumn("excess", F.round("excess", 4))


@query("varying_columns", """
SELECT 'l_linestatus' AS name, CAST(count(DISTINCT l_linestatus) > 1 AS INTEGER) AS varies FROM lineitem
UNION ALL SELECT 'l_tax', CAST(count(DISTINCT l_tax) > 1 AS INTEGER) FROM lineitem
UNION ALL SELECT 'same', CAST(count(DISTINCT l_quantity * 0) > 1 AS INTEGER) FROM lineitem
UNION ALL SELECT 'gaps', CAST(count(DISTINCT coalesce(nullif(l_returnflag, 'A'), '-')) > 1 AS INTEGER)
FROM lineitem WHERE l_returnflag IN ('A', 'N')""")
def varying_columns(spark, sf):
    """A constant column does not vary; one that is constant but for gaps does."""
    rows = table(spark, sf, "lineitem").select(
        "l_linestatus", "l_tax", (F.col("l_quantity") * 0).alias("same"),
        F.when(F.col("l_returnflag") == "N", "N").alias("gaps"))
    return varying(rows, ["l_linestatus", "l_tax", "same", "gaps"])


# ------------------------------------------------------------------------------------------ cross tables


_LONG = _LINES + """,
long AS (SELECT 'l_returnflag' AS variable, l_returnflag AS level, l_linestatus AS class FROM l
         UNION ALL SELECT 'band', band, l_linestatus FROM l),
counts AS (SELECT variable, level, class, count(*) AS n FROM long GROUP BY 1, 2, 3)
"""
_NUMBERS = """,
numbers AS (SELECT 'l_quantity' AS variable, l_linestatus AS class, l_quantity AS v FROM l
            UNION ALL SELECT 'l_discount', l_linestatus, l_discount * 100 FROM l)
"""


def numeric_lines(spark, sf):
    return lines(spark, sf).withColumn("l_discount", F.col("l_discount") * 100)


@query("summary_crosstab", _LONG + _NUMBERS + """,
every AS (SELECT * FROM counts UNION ALL SELECT variable, level, 'Total', sum(n) FROM counts GROUP BY 1, 2),
moments AS (SELECT variable, class, avg(v) AS m, stddev_samp(v) AS s FROM numbers GROUP BY 1, 2
            UNION ALL SELECT variable, 'Total', avg(v), stddev_samp(v) FROM numbers GROUP BY 1)
SELECT variable, level, class, CAST(n AS BIGINT) || ' (' || regexp_replace(CAST(round(n * 100.0::DOUBLE
       / sum(n) OVER (PARTITION BY variable, class), 1) AS VARCHAR), '\\.0$', '') || ')' AS text FROM every
UNION ALL SELECT variable, 'Mean (SD)', class, regexp_replace(CAST(round(m, 1) AS VARCHAR), '\\.0$', '') || ' ('
       || regexp_replace(CAST(round(s, 1) AS VARCHAR), '\\.0$', '') || ')' FROM moments""")
def summary_crosstab(spark, sf):
    return C.summary_crosstab(numeric_lines(spark, sf), "l_linestatus", ["l_returnflag", "band"], ["l_quantity", "l_discount"])


# Both categorical variables have two degrees of freedom, where the tail of a chi-square is exp(-x / 2). The tail of Student's
# t comes from sums over its density.
@query("crosstab_tests", _LONG + _NUMBERS + """,
m AS (SELECT *, sum(n) OVER (PARTITION BY variable) AS t, sum(n) OVER (PARTITION BY variable, level) AS r,
             sum(n) OVER (PARTITION BY variable, class) AS c FROM counts),
s AS (SELECT variable, class, count(*) AS n, avg(v) AS m, var_samp(v) / count(*) AS q FROM numbers GROUP BY 1, 2),
w AS (SELECT a.variable, abs(a.m - b.m) / sqrt(a.q + b.q) AS t,
             (a.q + b.q) ^ 2 / (a.q ^ 2 / (a.n - 1) + b.q ^ 2 / (b.n - 1)) AS k
      FROM s a JOIN s b ON a.variable = b.variable AND a.class = 'F' AND b.class = 'O'),
x AS (SELECT (i + 0.5::DOUBLE) / 100000 AS u FROM range(100000) r(i))
SELECT variable, round(exp(-sum((n - r * c / t) ^ 2 / (r * c / t)) / 2), 6) AS p FROM m GROUP BY variable
UNION ALL SELECT variable, round(1 - sum(t * exp(-(k + 1) / 2 * ln(1 + (t * u) ^ 2 / k)))
                                     / sum(60 * exp(-(k + 1) / 2 * ln(1 + (60 * u) ^ 2 / k))), 6) FROM w, x GROUP BY variable""")
def crosstab_tests(spark, sf):
    tests = C.crosstab_tests(numeric_lines(spark, sf), "l_linestatus", ["l_returnflag", "band"],
                             ["l_quantity", "l_discount"], ("F", "O"))
    return tests.select("variable", F.round("p", 6).alias("p"))


@query("chi_square", _LONG + """,
m AS (SELECT *, sum(n) OVER (PARTITION BY variable) AS t, sum(n) OVER (PARTITION BY variable, level) AS r,
             sum(n) OVER (PARTITION BY variable, class) AS c FROM counts)
SELECT variable, round(sum((n - r * c / t) ^ 2 / (r * c / t)), 4) AS statistic,
       CAST((count(DISTINCT level) - 1) * (count(DISTINCT class) - 1) AS BIGINT) AS df FROM m GROUP BY variable""")
def chi_square(spark, sf):
    tests = C.chi_square(C.class_counts(lines(spark, sf), "l_linestatus", ["l_returnflag", "band"]))
    return tests.select("variable", F.round("statistic", 4).alias("statistic"), "df")


@query("welch_t", _LINES + _NUMBERS + """,
s AS (SELECT variable, class, count(*) AS n, avg(v) AS m, var_samp(v) / count(*) AS q FROM numbers GROUP BY 1, 2)
SELECT a.variable, round((a.m - b.m) / sqrt(a.q + b.q), 5) AS t,
       round((a.q + b.q) ^ 2 / (a.q ^ 2 / (a.n - 1) + b.q ^ 2 / (b.n - 1)), 3) AS df
FROM s a JOIN s b ON a.variable = b.variable AND a.class = 'F' AND b.class = 'O'""")
def welch_t(spark, sf):
    tests = C.welch_t(C.class_moments(numeric_lines(spark, sf), "l_linestatus", ["l_quantity", "l_discount"]), "F", "O")
    return tests.select("variable", F.round("t", 5).alias("t"), F.round("df", 3).alias("df"))


# ------------------------------------------------------------------------------------------- hold-out


@query("holdout_split", """
WITH d AS (SELECT o_orderkey, r.rep, md5(o_orderkey || '|' || r.rep || '|') AS h
           FROM orders, (SELECT CAST(unnest([1, 2, 3]) AS INTEGER) AS rep) r)
SELECT o_orderkey, rep, CASE WHEN row_number() OVER (PARTITION BY rep ORDER BY h)
       <= floor(count(*) OVER (PARTITION BY rep) * 0.7) THEN 1 ELSE 0 END AS in_train FROM d""")
def holdout_split(spark, sf):
    return S.holdout_split(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 0.7, 3)


def scored(spark, sf) -> DataFrame:
    """Labelled documents with a score that grows with their length."""
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", "lang", "source")
    return salted_join(table(spark, sf, "labels").select("doc_id", "quality"), docs, ["doc_id"])


_SCORED = """
WITH s AS (SELECT quality, least(n_chars / 4000.0::DOUBLE, 1) AS score FROM labels JOIN documents USING (doc_id))
"""


@query("classification_metrics", _SCORED + """
SELECT round(avg(CASE WHEN (score > 0.5) = (quality = 1) THEN 1.0 ELSE 0 END), 6) AS accuracy,
       round(count(*) FILTER (WHERE score <= 0.5 AND quality = 0) / count(*) FILTER (WHERE score <= 0.5), 6) AS precision,
       round(count(*) FILTER (WHERE score <= 0.5 AND quality = 0) / count(*) FILTER (WHERE quality = 0), 6) AS recall
FROM s""")
def classification_metrics(spark, sf):
    rows = scored(spark, sf).withColumn("score", F.least(F.col("n_chars") / 4000.0, F.lit(1.0)))
    found = M.classification_metrics(rows, "quality", "score", event=0)
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


@query("roc_auc", _SCORED + """,
r AS (SELECT quality, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS place FROM s)
SELECT round((sum(place) FILTER (WHERE quality = 1) - count(*) FILTER (WHERE quality = 1)
              * (count(*) FILTER (WHERE quality = 1) + 1) / 2)
             / (count(*) FILTER (WHERE quality = 1) * count(*) FILTER (WHERE quality = 0)), 6) AS roc_auc FROM r""")
def roc_auc(spark, sf):
    rows = scored(spark, sf).withColumn("score", F.least(F.col("n_chars") / 4000.0, F.lit(1.0)))
    return M.roc_auc(rows, "quality", "score").withColumn("roc_auc", F.round("roc_auc", 6))


CURVE_LEVELS = {"length": ["short", "middle", "long"], "lang": ["en", "de", "es", "fr"], "src": ["low", "high"]}
CURVE_PROPS = [round(0.25 + 0.01 * i, 2) for i in range(51)]


def curve_rows(spark, sf) -> DataFrame:
    return scored(spark, sf).select(
        "quality", "lang", E.choose([(F.col("n_chars") < 500, "short"), (F.col("n_chars") < 3000, "middle")], "long").alias("length"),
        F.when(F.col("source") < "src5", "low").otherwise("high").alias("src"))


@query("metric_curve")
def metric_curve(spark, sf):
    """51 training proportions x 10 repetitions."""
    return S.metric_curve(curve_rows(spark, sf), "quality", list(CURVE_LEVELS), CURVE_LEVELS, CURVE_PROPS, 10)


@query("curve_sizes", """
SELECT CAST(p AS DOUBLE) / 100 AS prop, 10::BIGINT AS reps, CAST(count(*) - floor(count(*) * p / 100.0::DOUBLE + 1e-9) AS BIGINT) AS held_out,
       true AS bounded
FROM (SELECT * FROM labels JOIN documents USING (doc_id)), range(25, 76) r(p) WHERE quality IS NOT NULL AND lang IS NOT NULL AND n_chars IS NOT NULL GROUP BY p""")
def curve_sizes(spark, sf):
    """Held-out rows (scored and skipped) of every split of ``metric_curve``, and whether its metrics are shares."""
    found = S.split_metrics(curve_rows(spark, sf), "quality", list(CURVE_LEVELS), CURVE_LEVELS, CURVE_PROPS, 10)
    wide = found.groupBy("prop", "rep").agg(
        F.sum(F.when(F.col("metric").isin("scored", "skipped"), F.col("estimate"))).alias("held_out"),
        F.min(F.col("metric").isin("scored", "skipped") | F.coalesce(F.col("estimate").between(0, 1), F.lit(True))).alias("bounded"))
    return wide.groupBy("prop").agg(F.count("*").alias("reps"), F.max("held_out").cast("long").alias("held_out"), F.min("bounded").alias("bounded"))
