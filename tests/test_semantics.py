"""Small fixtures for the rules that are easy to get wrong."""

import pytest
from pyspark.sql import functions as F

from kinpanel.functions import arrays as A
from kinpanel.functions import expressions as E
from kinpanel.operators import aggregates as G
from kinpanel.operators import household as H
from kinpanel.operators import joins as J
from kinpanel.operators import reshape as R
from kinpanel.plans.survey import CHILD_OF, RULES, prepare_facts, prepare_persons
from kinpanel.session import checkpointed
from kinpanel.sources import tables as S
from kinpanel.stats import metrics as M


def test_three_valued_flag(rows, listed):
    df = rows("id int, educ int, j90 int", [(1, None, None), (2, 20, None), (3, 3, 4), (4, None, 16)])
    test = E.any_of([F.coalesce(F.col("educ"), F.lit(-1)) >= 19, F.col("j90") == 16])
    assert listed(df.select("id", E.three_valued(test))) == [(1, None), (2, 1), (3, 0), (4, 1)]


def test_bands_fall_through_unknown_conditions(rows, listed):
    df = rows("id int, v int", [(1, None), (2, 5), (3, 50)])
    assert listed(df.select("id", E.choose([(F.col("v") > 10, "big"), (F.col("v") > 1, "small")], "none"))) == [
        (1, "none"), (2, "small"), (3, "big")]


def test_top_code_and_levels(rows, listed):
    label = E.top_code(F.col("v"), 4)
    df = rows("v int", [(1,), (3,), (4,), (9,)]).select("v", label, E.level_index(label, E.top_code_levels(4)))
    assert listed(df) == [(1, "1", 1), (3, "3", 3), (4, ">=4", 4), (9, ">=4", 4)]


def test_grid_names(rows, listed):
    kid, parent = E.relation_slots(F.col("n"))
    df = rows("n string", [("b2.9.1",), ("b2.91",), ("b10.911",)]).select("n", kid, parent)
    assert listed(df) == [("b10.911", "10", "11"), ("b2.9.1", "2", "1"), ("b2.91", "2", "1")]


def test_number_text(rows, listed):
    df = rows("id int, e double, s double, p double", [(1, 1.5, 0.25, 0.0004), (2, -2.0, 0.1236, 0.04), (3, 1.0, 1.0, None)])
    got = listed(df.select("id", E.estimate_label(F.col("e"), F.col("s"), F.col("p"))))
    assert got == [(1, "1.5 (0.25)***"), (2, "-2 (0.124)*"), (3, "1 (1)")]
    assert rows("n long, s double", [(12345, 0.5)]).select(E.share_label(F.col("n"), F.col("s"))).first()[0] == "12,345 (50%)"


def test_missing_list_is_empty(rows, listed):
    df = rows("id int, l array<int>", [(1, None), (2, [4, 6, 4]), (3, [None, 5])])
    l = F.col("l")
    got = listed(df.select("id", A.has_value(l, 4), A.has_any(l, [4, 9]), A.count_value(l, 4), A.length(l), A.only_value(l)))
    assert got == [(1, False, False, 0, 0, None), (2, True, True, 2, 3, None), (3, False, False, 0, 2, None)]


def test_unpivot_drops_missing_and_pivot_restores(rows, listed):
    wide = rows("id int, a int, b int", [(1, 10, None), (2, None, 20), (3, 1, 2)])
    long = R.to_long(wide, ["id"], ["a", "b", "absent"])
    assert listed(long) == [(1, "a", 10), (2, "b", 20), (3, "a", 1), (3, "b", 2)]
    assert listed(R.to_wide(long, ["id"], "name", ["a", "b"], F.first("value"))) == listed(wide)


def test_transpose_twice_is_identity(rows, listed):
    t = rows("term string, x string, y string", [("a", "1", "2"), ("b", "3", None)])
    once = R.transpose(t, "term", ["x", "y"], ["a", "b"], "spec")
    assert listed(R.transpose(once, "spec", ["a", "b"], ["x", "y"])) == listed(t)


def test_aligned_lists(rows, listed):
    df = rows("k int, slot int, code int", [(1, 2, 20), (1, 1, 30), (1, 2, 20), (2, 5, 1)])
    assert listed(G.aligned_lists(df, ["k"], slot="slot", code="code")) == [(1, [1, 2], [30, 20]), (2, [5], [1])]


def test_entity_min_and_missing(rows, listed):
    df = rows("id int, v int", [(1, 5), (1, None), (2, 7), (2, 6)])
    for kept in (False, True):
        assert listed(G.entity_min(df, ["id"], "v", "m", one_per_wave=kept), "id", "m") == [(1, 5), (1, 5), (2, 6), (2, 6)]
        strict = G.entity_min(df, ["id"], "v", "m", propagate_null=True, one_per_wave=kept)
        assert listed(strict, "id", "m") == [(1, None), (1, None), (2, 6), (2, 6)]


def test_ever_and_carried_flags_differ(rows, listed):
    df = rows("id int, t int, f int", [(1, 1, 0), (1, 2, 1), (1, 3, None), (2, 1, None)])
    assert listed(G.ever_flag(df, ["id"], "f", "e"), "id", "t", "e") == [(1, 1, 1), (1, 2, 1), (1, 3, 1), (2, 1, 0)]
    assert listed(G.carry_forward_flag(df, ["id"], "t", "f", "e"), "id", "t", "e") == [(1, 1, 0), (1, 2, 1), (1, 3, 1), (2, 1, 0)]


def test_quartiles(rows, listed):
    df = rows("w int, v int", [(1, 1), (1, 2), (1, 4), (1, None)])
    got = listed(G.quantile_band(df, ["w"], "v", "b", ["I", "II", "III", "IV"]), "v", "b")
    # 25 % point 1.5, median 2, 75 % point 3
    assert got == [(None, None), (1, "I"), (2, "II"), (4, "IV")]


def test_population_gap_falls_to_the_lower_band(rows):
    facts = rows("id_w int, id_h long, totexpr long, popul long, status int, ncat5 int, ncat6 int", [
        (1, 1, 10, 7_500_000, 1, 1, None), (1, 2, None, 5_000_000, 1, 1, 1), (1, 3, 30, 9_000_000, 3, None, None)])
    got = {r["id_h"]: (r["residence"], r["elders_presence"], r["totexpr"]) for r in prepare_facts(facts).collect()}
    assert got == {1: ("1mln", 0, "I Q"), 2: ("SPB", 2, None), 3: ("village", 0, "IV Q")}


def test_birth_year_is_the_smallest_report(rows):
    raw = rows("idind long, year int, age int, born_a int, born_b int, educ int, diplom int, diplom_1 int, j90 int, "
               "occup08 int, j1 int, j4_2 int, h5 int", [
                   (1, 2010, 30, None, None, 3, 1, 1, 1, None, 5, None, 1), (1, 2011, 31, 1981, None, 3, 1, 1, None, None, 2, 4, 1)])
    got = {r["year"]: (r["birth_year"], r["univ_diploma"], r["profession_code"]) for r in prepare_persons(raw).collect()}
    assert got == {2010: (1980, 0, -1), 2011: (1980, None, 4)}


def test_asof_keeps_ties(rows, listed):
    left = rows("k int, lt int, l string", [(1, 10, "a"), (1, 20, "b"), (1, 3, "c"), (None, 9, "n"), (2, 9, "o")])
    right = rows("k int, rt int, r string", [(1, 5, "x"), (1, 5, "y"), (1, 15, "z"), (None, 1, "q"), (3, 1, "w")])
    matched = [("a", "x"), ("a", "y"), ("b", "z")]
    for buckets in (1, 4):
        assert listed(J.asof_join(left, right, ["k"], "lt", "rt", "inner", buckets), "l", "r") == matched
        got = listed(J.asof_join(left, right, ["k"], "lt", "rt", "left", buckets), "l", "r")
        assert got == [*matched, ("c", None), ("n", None), ("o", None)]


def test_difference_of_shares_with_a_missing_class(rows, listed):
    people = rows("year int, id int, c string", [(1, 1, "a"), (1, 2, "b"), (2, 3, "a")])
    sample = rows("year int, id int, c string", [(1, 1, "a")])
    got = listed(H.deviations(sample, people, "year", "id", "id", {"b": ("c", "b"), "a": ("c", "a")}))
    assert got == [(1, "a", 0.5), (1, "b", -0.5), (2, "a", -1.0), (2, "b", 0.0)]
    shares = [G.class_shares(d, ["year"], ["c"], "id") for d in (sample, people)]
    assert listed(J.share_difference(*shares, ["year", "c"])) == [(1, "a", 0.5), (1, "b", -0.5), (2, "a", -1.0)]


def test_pair_example(rows, listed):
    """Person 1 (male) is a child of person 2 (female)."""
    roster = rows("id_w int, id_h int, idind1 long, idind2 long, `b1.5` int, `b2.5` int, `b1.9.2` int, `b2.91` int",
                  [(1, 7, 101, 102, 1, 2, 4, 2)])
    pairs = H.relation_pairs(roster, ["id_w", "id_h"], ["b1.9.2", "b2.91", "b3.9.1"], ["idind1", "idind2", "idind3"],
                             ["b1.5", "b2.5"])
    got = listed(pairs, "value", "kid_id", "gender", "parent_id", "parent_type", "relatives_list", "relatives_slots")
    assert got == [(2, 102, "female", 101, "father", [2], ["1"]), (4, 101, "male", 102, "mother", [4], ["2"])]


PAIRS = "id_w int, id_h int, value int, kid_id long, gender string, parent_id long, parent_type string, " \
        "relatives_list array<int>, relatives_slots array<string>"


def _tie(kid, parent, kind, wave=1):
    return (wave, 1, CHILD_OF, kid, "male", parent, kind, [4, 4], ["1", "2"])


def test_unknown_birth_years_are_a_group_and_stay(rows, listed):
    pairs = rows("id_w int, id_h long, value int, kid_id long, gender string, parent_id long, parent_type string, "
                 "relatives_list array<int>, relatives_slots array<string>",
                 [(1, h, 4, kid, "male", parent, kind, [4, 4], ["1", "2"]) for h, kid, father, mother in
                  [(1, 1, 10, 20), (2, 2, 11, 20), (3, 3, 12, 22), (3, 4, 12, 22)]
                  for parent, kind in ((father, "father"), (mother, "mother"))])
    persons = rows("idind long, id_w int, year int, birth_year int",
                   [(1, 1, 2000, None), (2, 1, 2000, None), (3, 1, 2000, None), (4, 1, 2000, 1990)])
    got = H.assign_parents(pairs, persons, 4)
    assert listed(got, "kid_id", "birth_year") == [(3, None), (4, 1990)]
    assert listed(H.sibling_order(got, ["father_id", "mother_id"], "birth_year"), "kid_id", "kid_order") == [(3, None), (4, 1)]


def test_chosen_columns_must_have_slots(rows):
    roster = rows("id_w int, id_h int, idind1 long, `b1.5` int, note int", [(1, 1, 1, 1, 1)])
    with pytest.raises(ValueError):
        H.relation_pairs(roster, ["id_w", "id_h"], ["note"], ["idind1"], ["b1.5"])


def test_parents_must_be_certain(rows, listed):
    pairs = rows(PAIRS, [
        _tie(1, 10, "father"), _tie(1, 11, "mother"),                             # kept
        _tie(2, 10, "father"), _tie(2, 12, "father"), _tie(2, 11, "mother"),      # two fathers
        _tie(3, 20, "mother"),                                                    # no father
        _tie(4, 30, "father"), _tie(4, 31, "mother"), _tie(5, 32, "father"), _tie(5, 31, "mother"),  # same mother and year
        _tie(9, 40, "father"), _tie(9, 41, "mother")])                            # excluded
    persons = rows("idind long, id_w int, year int, birth_year int", [(i, 1, 2000, 1980) for i in (1, 2, 3, 4, 5, 9)])
    got = H.assign_parents(pairs, persons, CHILD_OF, excluded=rows("id long", [(9,)]))
    assert listed(got, "kid_id", "father_id", "mother_id", "birth_year") == [(1, 10, 11, 1980)]


def test_siblings_share_a_place(rows, listed):
    df = rows("f int, m int, kid int, born int", [(1, 2, 1, 1980), (1, 2, 2, 1980), (1, 2, 3, 1985), (5, 6, 4, 1990)])
    assert listed(H.sibling_order(df, ["f", "m"], "born"), "kid", "kid_order") == [(1, 1), (2, 1), (3, 2), (4, 1)]


def test_parent_flag_rules(rows, listed):
    persons = rows("idind long, year int, f int", [(1, 2000, 0), (1, 2005, 1)])
    panel = rows("father_id long, year int", [(1, 1999), (1, 2001), (1, 2006)])
    known = H.known_flags(persons, "idind", "year", "f")
    assert listed(H.with_parent_flag(panel, known, "father_id", "year", "v"), "year", "v") == [(2001, 1), (2006, 1)]
    assert listed(H.with_parent_flag(panel, known, "father_id", "year", "v", True), "year", "v") == [(2001, 0), (2006, 1)]


def test_apart_needs_the_same_wave_and_both_parents(rows, listed):
    sample = rows("kid long, f long, m long, year int", [(1, 10, 11, 2005), (2, 10, 11, 2005), (3, 10, 11, 2002)])
    seen = rows("id long, year int, h int", [
        (10, 2003, 1), (11, 2003, 1), (10, 2004, 1), (11, 2004, 2),
        (1, 2003, 9), (2, 2004, 2), (3, 2003, 9), (2, 2005, 9)])
    assert listed(J.apart_together(sample, seen, "kid", ["f", "m"], "year", "id", "year", "h")) == [(1,)]


def test_twin_households(rows, listed):
    df = rows("hh int, id int, born int, age int", [
        (1, 1, 1990, 20), (1, 2, 1995, 15), (1, 3, 1995, 15), (2, 4, 1990, 20), (2, 5, 1990, 20), (2, 6, 1995, 15)])
    assert listed(H.twin_last_births(df, "hh", "id", "born", "age", 10, 1970, (19, 25)), "id", "twin_year") == [(1, 1995)]


def test_first_year_ties_and_sample(rows, listed):
    """Two children of one couple: counted from the longest list, the first observation of age kept, tied lists kept."""
    panel = rows(
        "kid_id long, year int, age int, kid_univ_diploma int, gender string, profession_code int, origsm int, id_w int, id_h int, "
        "father_id long, mother_id long, birth_year int, kid_order int, totexpr string, relatives_list array<int>, "
        "relatives_slots array<string>", [
            (1, 1998, 18, 0, "male", 3, 1, 1, 1, 10, 11, 1980, 1, "II Q", [4, 4], ["1", "2"]),
            (1, 2002, 22, 1, "male", 3, 1, 5, 1, 10, 11, 1980, 1, "IV Q", [4, 4], ["1", "2"]),
            (2, 2002, 21, 0, "male", -1, 1, 5, 1, 10, 11, 1981, 2, "IV Q", [4, 4, 6], ["1", "2", "3"]),
            (1, 2003, 23, 1, "male", 3, 1, 6, 1, 10, 11, 1980, 1, "I Q", [4, 4], ["1", "2"])])
    seen = rows("idind long, year int, id_h int", [(1, 2001, 5), (10, 2001, 1), (11, 2001, 1), (2, 2001, 1)])
    got = H.analysis_sample(panel, seen, RULES)
    assert listed(got, "kid_id", "year", "kids_num", "kid_order", "hh_size", "lag_expenses", "is_separated", "prof",
                  "nuclear_family", "birth_year_trunc") == [
        (1, 2002, "2", "1", "4", "II Q", 1, "qualified", "1", 1980),
        (2, 2002, "2", "2", "4", None, 0, "unemployed", "1", 1980)]


def test_sample_moves_one_row_per_person(rows, listed, monkeypatch):
    """Beyond the family's numbers no other row of a person goes on; a row without a parent is no first observation."""
    lists = {11: [4, 4, 6], 12: [4, 4]}
    panel = rows(
        "kid_id long, year int, age int, kid_univ_diploma int, gender string, profession_code int, origsm int, id_w int, id_h int, "
        "father_id long, mother_id long, birth_year int, kid_order int, totexpr string, relatives_list array<int>, "
        "relatives_slots array<string>", [
            (kid, 1980 + age, age, 0, "male", 3, 1, age - 10, 1, None if kid == 12 and age == 20 else 1, 2, 1980, kid - 10, "II Q",
             lists[kid], ["1", "2", "3"]) for kid in lists for age in range(18, 31)])
    written = []

    def seen_by_test(df):
        written.append((df.columns, df.count()))
        return checkpointed(df)

    monkeypatch.setattr(H, "checkpointed", seen_by_test)
    got = H.analysis_sample(panel, rows("idind long, year int, id_h int", []), RULES)
    assert listed(got, "kid_id", "year", "kids_num", "hh_size") == [(11, 2000, "2", "4"), (12, 2001, "2", "4")]
    assert not any("relatives_slots" in columns for columns, _ in written)
    assert len(written) == 3 and written[0][1] == panel.count() and all(n <= 2 for _, n in written[1:])


def test_members_lists_are_made_before_the_pairs(rows):
    roster = rows("id_w int, id_h long, `b1.9.2` int, `b2.91` int, idind1 long, idind2 long, `b1.5` int, `b2.5` int",
                  [(1, 1, 4, 2, 10, 20, 1, 2)])
    pairs = H.relation_pairs(roster, ["id_w", "id_h"], ["b1.9.2", "b2.91"], ["idind1", "idind2"], ["b1.5", "b2.5"])
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Generate explode", 1)
    assert all(f"AS {c}#" in below and f"AS {c}#" not in above for c in ("relatives_list", "relatives_slots"))


def test_metrics_describe_class_zero(rows):
    df = rows("y int, s double", [(0, 0.1), (0, 0.7), (1, 0.9), (1, 0.2), (1, 0.8)])
    got = M.classification_metrics(df, "y", "s").first()
    assert (got["accuracy"], got["precision"], got["recall"]) == (0.6, 0.5, 0.5)
    none = M.classification_metrics(rows("y int, s double", [(1, 0.9)]), "y", "s").first()
    assert none["recall"] is None and none["precision"] is None


def test_labels_survive_the_dictionary(spark, rows, tmp_path):
    df = S.with_labels(rows("a int, b int", [(1, 2)]), {"a": "age of person"})
    data, dictionary = S.ingest_labelled(df, str(tmp_path))
    words = S.load(spark, dictionary)
    assert S.columns_by_label(words, "of person", S.load(spark, data).columns) == ["a"]
    assert S.columns_by_label(words, "of person", ["b"]) == []


def test_columns_that_vary(rows, listed):
    from kinpanel.stats.specs import varying_columns

    df = rows("a int, b int, c int, d int", [(1, 1, None, None), (2, 1, 3, None)])
    assert listed(varying_columns(df, ["a", "b", "c", "d"])) == [("a", 1), ("b", 0), ("c", 1), ("d", 0)]


def test_unknown_join_kind_is_refused(rows):
    from kinpanel.operators.scale import salted_join

    with pytest.raises(ValueError):
        salted_join(rows("k int", [(1,)]), rows("k int", [(1,)]), ["k"], "full")
