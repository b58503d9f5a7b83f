"""What the physical plans must and must not contain."""

import contextlib
import io
import os
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from kinpanel.operators import household as H
from kinpanel.plans import survey as V

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(queries()["range_filters"](spark, SF))
    assert "GreaterThanOrEqual(l_shipdate" in text and "In(l_returnflag" in text
    assert "l_extendedprice" not in text and "Exchange" not in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_returnflag:string>" in plan(
        queries()["scan_projected"](spark, SF))


def test_pairs_need_no_shuffle(spark):
    roster = V.raw_roster(V.raw_persons(spark, SF))
    written = spark.createDataFrame([], roster.schema)
    names = roster.columns
    pairs = H.relation_pairs(written, ["id_w", "id_h"], [c for c in names if ".9" in c],
                             [c for c in names if c.startswith("idind")], [c for c in names if c.endswith(".5")])
    assert "Exchange" not in plan(pairs)


@pytest.mark.parametrize("name", ["asof_inner", "asof_left", "separation_flag", "twin_households", "quantile_band",
                                  "share_within_group", "holdout_split", "roc_auc", "chi_square", "metric_curve"])
def test_no_product_joins(spark, name):
    text = plan(queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_shares_shuffle_counts_not_rows(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("a"), (F.col("id") % 2).alias("b"))
    from kinpanel.operators.aggregates import class_shares

    assert "partial_count" in plan(class_shares(df, ["a"], ["b"]))


@pytest.mark.parametrize("gone", [["kinpanel/llm", "tests/llm"], ["kinpanel/llm", "tests/llm", "corpus_pipeline.py"]])
def test_the_rest_works_without_the_training_data_operators(tmp_path, gone):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    left = {os.path.join(root, g) for g in gone}
    shutil.copytree(root, tmp_path / "copy", ignore=lambda folder, names: [
        n for n in names if os.path.join(folder, n) in left or n in (".git", "__pycache__")])
    code = ("import __spark_entry__ as e; from kinpanel.session import build_session; s = build_session('t', 'local[2]', 2, "
            "spark__ui__enabled='false'); n = e.queries(); assert not any(k.startswith('op') or k == 'pipeline' for k in n); "
            f"assert not set(e.oracle_sql()) - set(n); assert n['share_within_group'](s, {SF!r}).count() > 0")
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "copy", capture_output=True, text=True, timeout=300,
                          env={**os.environ, "PYTHONPATH": str(tmp_path / "copy")})
    assert done.returncode == 0, done.stderr[-2000:]


def test_panel_odds_ratios_and_curve(spark):
    """Odds ratios are those of the fits on the same people and lie inside their limits; the curve's shares are shares."""
    from kinpanel.session import checkpointed
    from kinpanel.stats.logit import fit_specifications, score_check

    larger = SF.replace("0.001", "0.01")  # on the smallest tables most classes are separated
    sample = checkpointed(V.sample_of(spark, larger, V.SurveyTables(spark, larger)))
    got = {(r["variable"] + r["level"]): r for r in V.odds_of(sample, ["is_separated"]).collect()}
    fit = fit_specifications(sample, "univ_diploma", {"all": [*V.SHOWN, "is_separated"]}, V.MODEL_LEVELS)
    estimates = {r["term"]: r["estimate"] for r in fit.collect()}
    shown = [t for t in got if got[t]["odds_ratio"] is not None and abs(estimates[t]) < 10]
    assert len(shown) > 8
    for term in shown:
        row = got[term]
        assert abs(row["odds_ratio"] / 2.718281828459045 ** estimates[term] - 1) < 1e-6
        assert (row["low"] or 0) < row["odds_ratio"] < (row["high"] or float("inf"))
    # an independent look at the same fit: sums over the people, not over patterns
    scores = score_check(sample, "univ_diploma", [*V.SHOWN, "is_separated"], V.MODEL_LEVELS, fit.filter("estimate IS NOT NULL"))
    nobs = fit.first()["nobs"]
    assert all(abs(r["score"]) / nobs < 1e-4 for r in scores.collect())
    curve = queries()["panel_metric_curve"](spark, SF).collect()
    assert {r["type"] for r in curve} == {"all", "not separated"} and len(curve) == 2 * 51 * 5
    assert all(r["avg_estimate"] is None or 0 <= r["avg_estimate"] <= 1 for r in curve if r["metric"] != "skipped")


def test_folder_ingest_takes_only_what_changed(spark, tmp_path):
    from kinpanel.sources import tables as S

    for name in ("a", "b"):
        spark.range(3).write.parquet(f"{tmp_path}/in/{name}.parquet")
    labels = {"a": {"id": "number"}, "b": {}}
    first = S.ingest_folder(spark, f"{tmp_path}/in", f"{tmp_path}/out", labels).collect()
    assert [r["taken"] for r in first] == [True, True]
    assert [tuple(r) for r in S.load(spark, first[0]["dictionary"]).collect()] == [("number", "id")]
    spark.range(5).write.mode("overwrite").parquet(f"{tmp_path}/in/b.parquet")
    again = {r["table"]: r for r in S.ingest_folder(spark, f"{tmp_path}/in", f"{tmp_path}/out", labels).collect()}
    assert (again["a"]["taken"], again["b"]["taken"]) == (False, True) and again["a"]["data"] == first[0]["data"]
    assert S.load(spark, again["b"]["data"]).count() == 5
    # without a manifest the folder is half done: everything is taken again
    shutil.rmtree(tmp_path / "out" / "manifest")
    assert all(r["taken"] for r in S.ingest_folder(spark, f"{tmp_path}/in", f"{tmp_path}/out", labels).collect())


def test_stage_tables_of_a_block_are_removed(spark):
    from kinpanel import session

    kept = session.checkpointed(spark.range(3))
    before = len(session._STAGES)
    with session.own_stages(spark):
        assert queries()["entity_min"](spark, SF).count() > 0
        made = session._STAGES[before:]
    assert kept.count() == 3 and made and len(session._STAGES) == before
    assert not any(os.path.isdir(p.removeprefix("file:")) for p in made)
