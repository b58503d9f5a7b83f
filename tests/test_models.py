"""Models and tests against closed forms, independent fits and table values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import tests.dense as D
from kinpanel.functions import special as P
from kinpanel.stats import crosstab as C
from kinpanel.stats import holdout as S
from kinpanel.stats import logit as L
from kinpanel.stats.patterns import compress
from kinpanel.stats.specs import coefficient_table, nested_specifications

LEVELS = {"x": ["0", "1"], "z": ["a", "b", "c"]}


def counted(spark, cells, schema="x string, y int, n int"):
    """Rows from (…, y, count) cells."""
    return spark.createDataFrame(cells, schema).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("i", "n")


@pytest.fixture(scope="module")
def closed(spark):
    return counted(spark, [("1", 1, 30), ("1", 0, 10), ("0", 1, 20), ("0", 0, 40)])


@pytest.fixture(scope="module")
def two(spark):
    rng, rows = np.random.default_rng(7), []
    for x in "01":
        for z in "abc":
            p = 1 / (1 + math.exp(-(-0.4 + 0.7 * (x == "1") - 0.5 * (z == "b") + 0.2 * (z == "c"))))
            hits = int(rng.binomial(3000, p))
            rows += [(x, z, 1, hits), (x, z, 0, 3000 - hits)]
    return counted(spark, rows, "x string, z string, y int, n int")


def by_term(fit, *columns):
    return {r["term"]: tuple(r[c] for c in columns) for r in fit.collect()}


@pytest.mark.parametrize("how", ["tasks", "distributed"])
def test_closed_form(closed, how):
    fit = L.fit_specifications(closed, "y", {"m": ["x"]}, LEVELS) if how == "tasks" else L.distributed_logit(
        closed, "y", ["x"], LEVELS)
    got = by_term(fit, "estimate", "std_error", "nobs", "converged")
    assert got["(Intercept)"][0] == pytest.approx(-0.693147, abs=1e-6)
    assert got["x1"][:2] == pytest.approx((1.791759, 0.456435), abs=1e-6)
    assert got["x1"][2:] == (100, True)


def test_both_fits_agree_and_meet_the_score_equations(two):
    a = L.fit_specifications(two, "y", {"m": ["x", "z"]}, LEVELS)
    b = L.distributed_logit(two, "y", ["x", "z"], LEVELS)
    columns = ("estimate", "std_error", "statistic", "deviance")
    left, right = by_term(a, *columns), by_term(b, *columns)
    assert set(left) == {"(Intercept)", "x1", "zb", "zc"}
    for term in left:
        assert left[term] == pytest.approx(right[term], rel=1e-6)
    assert all(abs(r["score"]) < 1e-4 for r in L.score_check(two, "y", ["x", "z"], LEVELS, a).collect())


def test_numeric_covariate(two):
    fit = L.distributed_logit(two.withColumn("num", F.when(F.col("z") == "c", 2.0).otherwise(1.0)), "y", ["x", "num"], {"x": ["0", "1"]})
    assert set(by_term(fit, "estimate")) == {"(Intercept)", "x1", "num"}


def test_aliased_and_separated(spark, closed):
    doubled = closed.withColumn("w", F.col("x"))
    levels = {**LEVELS, "w": ["0", "1"]}
    for fit in (L.fit_specifications(doubled, "y", {"m": ["x", "w"]}, levels), L.distributed_logit(doubled, "y", ["x", "w"], levels)):
        got = by_term(fit, "estimate", "std_error")
        assert got["w1"] == (None, None) and got["x1"][0] == pytest.approx(1.791759, abs=1e-6)
    apart = counted(spark, [("0", 1, 50), ("0", 0, 50), ("1", 1, 50)])
    assert {r["converged"] for r in L.fit_specifications(apart, "y", {"m": ["x"]}, LEVELS).collect()} == {False}


def test_baseline_and_unused_levels(spark):
    df = counted(spark, [("low", 1, 5), ("low", 0, 9), ("high", 1, 7), ("high", 0, 3)])
    got = by_term(L.fit_specifications(df, "y", {"m": ["x"]}, {"x": ["none", "low", "mid", "high"]}), "estimate")
    assert set(got) == {"(Intercept)", "xhigh"}


def test_missing_rows_leave_only_their_specification(spark):
    df = spark.createDataFrame([("0", "a", 1), ("1", None, 0), ("1", "b", 1), ("0", "b", 0), (None, "a", 1)] * 20,
                               "x string, z string, y int")
    fit = L.fit_specifications(df, "y", {"one": ["x"], "two": ["x", "z"]}, LEVELS)
    assert {(r["specification"], r["nobs"]) for r in fit.collect()} == {("one", 80), ("two", 60)}


def test_adding_a_variable_never_raises_the_deviance(two):
    fit = L.fit_specifications(two, "y", nested_specifications({"x": "x", "z": "z"}), LEVELS)
    dev = {r["specification"]: r["deviance"] for r in fit.collect()}
    assert dev["z"] < dev["x"]


@pytest.mark.parametrize("parts", [1, 13])
def test_models_do_not_depend_on_how_patterns_are_dealt(rows, monkeypatch, parts):
    """Separated, aliased, empty and intercept-only models, with all patterns in one task and spread over many."""
    data = [(i % 2 if x == "none" else int(x == "high"), x, "a" if i % 3 else "b", "a" if i % 3 else "b", None, "one")
            for i in range(60) for x in ("none", "low", "high")]
    df = rows("y int, x string, z string, twin string, gone string, flat string", data)
    levels = {"x": ["none", "low", "high"], "z": ["a", "b"], "twin": ["a", "b"], "gone": ["g"], "flat": ["one", "two"]}
    specs = {"separated": ["x"], "aliased": ["z", "twin"], "empty": ["z", "gone"], "constant": ["flat"]}
    plain = L.checkpointed
    monkeypatch.setattr(L, "checkpointed", lambda df: plain(df).repartition(parts))
    got = {(r["specification"], r["term"]): r for r in L.fit_specifications(df, "y", specs, levels).collect()}
    assert {s for s, _ in got} == {"separated", "aliased", "constant"}
    assert not got["separated", "xhigh"]["converged"] and got["separated", "xhigh"]["estimate"] > 15
    assert got["aliased", "twinb"]["estimate"] is None and got["aliased", "zb"]["estimate"] == pytest.approx(0, abs=1e-9)
    y = sum(d[0] for d in data) / len(data)
    assert got["constant", "(Intercept)"]["estimate"] == pytest.approx(math.log(y / (1 - y)))
    whole = {r["term"]: r for r in L.distributed_logit(df, "y", ["flat"], levels).collect()}
    assert whole["(Intercept)"]["estimate"] == pytest.approx(math.log(y / (1 - y)))
    assert whole["(Intercept)"]["std_error"] == pytest.approx(got["constant", "(Intercept)"]["std_error"])
    # an optional covariate without a second value is left out instead of emptying the model
    spared = L.fit_specifications(df, "y", {"m": ["gone", "flat", "z"]}, levels, optional=["gone", "flat"])
    assert [(r["term"], r["nobs"]) for r in spared.orderBy("position").collect()] == [("(Intercept)", 180), ("zb", 180)]


def test_specification_lists():
    specs = nested_specifications({"a": "x1", "b": ["x2", "x3"], "c": {"c1": "x4", "c2": ["x5", "x6"]}, "d": "x7"}, ["o"])
    assert specs == {"a": ["o", "x1"], "b": ["o", "x1", "x2", "x3"], "c1": ["o", "x1", "x2", "x3", "x4"],
                     "c2": ["o", "x1", "x2", "x3", "x5", "x6"], "d": ["o", "x1", "x2", "x3", "x5", "x6", "x7"]}


def test_coefficient_table(closed):
    fit = L.fit_specifications(closed, "y", {"first_step": ["x"]}, LEVELS)
    got = {r["term"]: r["+first step"] for r in coefficient_table(fit, ["x"], ["first_step"]).collect()}
    assert got == {"x1": "1.792 (0.456)***", "nobs": "100"}


def test_profile_limits_lie_where_the_likelihood_says(closed, two):
    row = L.profile_intervals(closed, "y", ["x"], LEVELS).first()
    assert row["odds_ratio"] == pytest.approx(6.0) and row["wald_low"] == pytest.approx(math.exp(1.791759 - 1.959964 * 0.456435), rel=1e-4)

    def loss(b0, b1):
        return sum(2 * (n * math.log1p(math.exp(b0 + b1 * x)) - s * (b0 + b1 * x)) for x, s, n in ((1, 30, 40), (0, 20, 60)))

    best = loss(math.log(0.5), math.log(6))
    for limit in (row["low"], row["high"]):
        b1 = math.log(limit)
        profiled = min(loss(b0, b1) for b0 in np.linspace(-3, 2, 20001))
        assert profiled - best == pytest.approx(3.841459, abs=1e-3)
    for r in L.profile_intervals(two, "y", ["x", "z"], LEVELS).collect():
        assert r["low"] < r["odds_ratio"] < r["high"] and r["low"] == pytest.approx(r["wald_low"], rel=0.01)


def test_special_functions_against_tables():
    assert P.chi_square_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert P.chi_square_tail(18.307038, 10) == pytest.approx(0.05, abs=1e-7)
    assert P.chi_square_tail(0.5, 4) == pytest.approx(1.25 * math.exp(-0.25))
    assert P.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert P.t_two_sided(12.706204736, 1) == pytest.approx(0.05, abs=1e-8)
    assert P.normal_two_sided(1.959963984540054) == pytest.approx(0.05)


def test_chi_square_with_and_without_correction(closed):
    counts = C.class_counts(closed, "y", ["x"])
    plain, yates = C.chi_square(counts).first(), C.chi_square(counts, correct=True).first()
    assert plain["statistic"] == pytest.approx(16.6667, abs=1e-4) and plain["df"] == 1
    # (|O - E| - 1/2)^2 summed over 1 / E with expected counts 20, 20, 30, 30
    assert yates["statistic"] == pytest.approx(9.5**2 * (2 / 20 + 2 / 30))
    assert plain["p"] == pytest.approx(math.erfc(math.sqrt(plain["statistic"] / 2)))


def test_welch(spark):
    df = spark.createDataFrame([("m", float(v)) for v in (1, 2, 3, 4)] + [("f", float(v)) for v in (2, 4, 6, 8, 10)], "c string, v double")
    got = C.welch_t(C.class_moments(df, "c", ["v"]), "m", "f").first()
    a, b = (5 / 3) / 4, 10 / 5
    assert got["t"] == pytest.approx((2.5 - 6) / math.sqrt(a + b))
    assert got["df"] == pytest.approx((a + b) ** 2 / (a * a / 3 + b * b / 4))


def test_crosstab_text(spark):
    df = spark.createDataFrame([("m", "a", 1.0), ("m", "b", 3.0), ("f", "a", 5.0), ("f", None, 7.0)], "c string, l string, v double")
    got = {(r["variable"], r["level"], r["class"]): r["text"] for r in C.summary_crosstab(df, "c", ["l"], ["v"]).collect()}
    assert got[("l", "a", "m")] == "1 (50)" and got[("l", "a", "f")] == "1 (100)" and got[("l", "a", "Total")] == "2 (66.7)"
    assert got[("v", "Mean (SD)", "m")] == "2 (1.4)" and got[("v", "Mean (SD)", "Total")] == "4 (2.6)"


def test_metric_curve(two):
    parts = S.split_metrics(two, "y", ["x", "z"], LEVELS, [0.25, 0.75], 3)
    got = {(r["prop"], r["rep"], r["metric"]): r["estimate"] for r in parts.collect()}
    assert len(got) == 2 * 3 * 6
    assert all(v is None or 0 <= v <= 1 for k, v in got.items() if k[2] not in ("skipped", "scored"))
    assert all(got[k] == 0 for k in got if k[2] == "skipped")
    assert len({got[(0.25, r, "roc_auc")] for r in (1, 2, 3)}) == 3
    again = {(r["prop"], r["rep"], r["metric"]): r["estimate"] for r in S.split_metrics(
        two.repartition(5), "y", ["x", "z"], LEVELS, [0.25, 0.75], 3).collect()}
    assert got == again


@pytest.mark.parametrize("block, event", [(10_000, 0), (2, 1)])
def test_every_split_is_scored_as_by_a_dense_fit(spark, monkeypatch, block, event):
    """Each split's counts, fitted and scored alone in one process; rare levels are missing from some training parts."""
    monkeypatch.setattr(S, "BLOCK_PATTERNS", block)
    levels = {"x": ["0", "1", "2"], "z": ["a", "b", "c"]}
    cells = [(x, z, y, 1 + (5 * i + 3 * j + 7 * y) % 9 if (x, z) != ("2", "c") else 1)
             for i, x in enumerate(levels["x"]) for j, z in enumerate(levels["z"]) for y in (0, 1) if (x, z) != ("2", "b")]
    rows = counted(spark, [(x, z, y, n if x != "2" else 1) for x, z, y, n in cells], "x string, z string, y int, n int")
    props, reps = [0.25, 0.5, 0.75], 4
    got = {(r["prop"], r["rep"], r["metric"]): r["estimate"] for r in S.split_metrics(rows, "y", ["x", "z"], levels, props, reps, 5, event).collect()}
    table = S.draw_splits(compress(rows, "y", levels), ["x", "z"], props, reps, 5).toPandas()
    hits, n = np.stack(table["train_hits"]), np.stack(table["train_n"])
    skipped = 0
    for cell in range(len(props) * reps):
        prop, rep = props[cell // reps], cell % reps + 1
        assert n[:, cell].sum() == int(table["n"].sum() * prop + 1e-9) and (hits[:, cell] <= table["successes"]).all()
        want = D.score_split(n[:, cell], hits[:, cell], table["n"].to_numpy() - n[:, cell], table["successes"].to_numpy() - hits[:, cell],
                             table, ["x", "z"], levels, event, 0.5)
        skipped += want["skipped"] > 0
        for metric, value in want.items():
            found = got[(prop, rep, metric)]
            assert found is None if math.isnan(value) else found == pytest.approx(value), (prop, rep, metric)
    assert skipped > 0


def test_unseen_levels_are_skipped_not_fatal():
    import pandas as pd

    pdf = pd.DataFrame({"x": ["0", "1"], "n": [10, 4]})
    got = D.score_split(np.array([6, 0]), np.array([3, 0]), np.array([4, 4]), np.array([2, 1]), pdf, ["x"], LEVELS, 0, 0.5)
    assert got["skipped"] == 4 and got["accuracy"] == 0.5
