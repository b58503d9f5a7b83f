"""Family ties, siblings, observation panels and analysis samples from a household panel.

Inputs are a wide roster (one row per household and wave), persons (one row per person and wave) and household facts
(one row per household and wave). Column names are parameters or plain neutral names; codes are parameters.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinpanel.functions import arrays as A
from kinpanel.functions import expressions as E
from kinpanel.operators import aggregates as G
from kinpanel.operators.joins import apart_together, asof_join, excluding, membership, only_members
from kinpanel.operators.reshape import stacked
from kinpanel.operators.scale import keep_at_extreme, salted_join, written_stats
from kinpanel.session import checkpointed


# ------------------------------------------------------------------------------------------------ ties


def _slots(columns: Sequence[str], shape: str) -> list[tuple[str, ...]]:
    """(column, slot…) read off the column names; a chosen column of another shape is an error, not left out."""
    found = [(c, re.match(shape, c)) for c in columns]
    odd = [c for c, m in found if not m]
    if odd:
        raise ValueError(f"no slot numbers in the names of {odd}")
    return [(c, *m.groups()) for c, m in found]


def relation_pairs(roster: DataFrame, keys: Sequence[str], relation_columns: Sequence[str],
                   id_columns: Sequence[str], gender_columns: Sequence[str], male_code: int = 1) -> DataFrame:
    """Ordered member pairs of every household-wave with the code of how the first is related to the second.

    Columns: keys, value, kid_id, gender, parent_id, parent_type, relatives_list, relatives_slots. ``roster`` has one row
    per household and wave; drop exact copies with ``distinct`` first. Slot numbers stand in column *names*, so which
    columns belong together is settled while planning, and everything about a household lies in its own row: the result is
    a projection and two explodes, with no shuffle. If a slot has several id or gender columns, the first answer counts.
    """
    present = set(roster.columns)

    def cells(columns: Sequence[str], shape: str) -> dict[tuple[str, ...], Column]:
        found: dict[tuple[str, ...], list[Column]] = {}
        for name, *slots in _slots([c for c in columns if c in present], shape):
            found.setdefault(tuple(slots), []).append(F.col(f"`{name}`"))
        return {slots: F.coalesce(*parts) for slots, parts in found.items()}

    grid = cells(relation_columns, r"^b?([^.]+)\.[^.]\.?([^.]+)$")
    ids = cells(id_columns, r"^idind(.+)$")
    sexes = cells(gender_columns, r"^b?([^.]+)\.")
    named = sorted(slot for (slot,) in ids if (slot,) in sexes)

    def relative(slot: str, value: Column) -> Column:
        known = (slot,) in ids and (slot,) in sexes
        return F.when(value.isNotNull(), F.struct(
            F.lit(slot).alias("slot"), value.cast("int").alias("value"),
            (ids[(slot,)] if known else F.lit(None)).cast("long").alias("id"),
            (sexes[(slot,)] if known else F.lit(None)).cast("int").alias("sex")))

    def member(slot: str) -> Column:
        # in slot order, so that equal lists are equal values
        own = [relative(b, value) for (a, b), value in sorted(grid.items(), key=lambda item: item[0]) if a == slot]
        known = ids[(slot,)].isNotNull() & sexes[(slot,)].isNotNull()
        return F.when(known, F.struct(ids[(slot,)].cast("long").alias("id"), sexes[(slot,)].cast("int").alias("sex"),
                                      F.array_compact(F.array(*own)).alias("own")))

    with_grid = [slot for slot in named if any(a == slot for a, _ in grid)]
    kids = roster.select(*keys, F.explode(F.array(*[member(slot) for slot in with_grid])).alias("k")).filter(
        F.col("k").isNotNull())
    # made once for a member, not for each of its pairs
    kids = kids.select(
        *keys, F.col("k.id").alias("kid_id"), E.choose([(F.col("k.sex") == male_code, "male")], "female").alias("gender"),
        F.col("k.own").alias("__own"), F.col("k.own.value").alias("relatives_list"), F.col("k.own.slot").alias("relatives_slots"))
    pairs = kids.withColumn("p", F.explode("__own")).filter(F.col("p.id").isNotNull() & F.col("p.sex").isNotNull())
    return pairs.select(
        *keys, F.col("p.value").alias("value"), "kid_id", "gender", F.col("p.id").alias("parent_id"),
        E.choose([(F.col("p.sex") == male_code, "father")], "mother").alias("parent_type"), "relatives_list", "relatives_slots")


def assign_parents(pairs: DataFrame, persons: DataFrame, tie: int, wave: str = "id_w", household: str = "id_h",
                   excluded: DataFrame | None = None) -> DataFrame:
    """Child x wave rows with exactly one father and one mother, and the child's earliest reported birth year.

    ``persons`` needs (idind, wave, year, birth_year). Couples that are ambiguous within a wave and birth year are
    dropped: a mother whose children of one birth year have two fathers, or the reverse. Unknown is a birth year of its own.
    """
    ties = pairs.filter(F.col("value") == tie)
    if excluded is not None:
        ties = excluding(ties, "kid_id", excluded)
    father = F.when(F.col("parent_type") == "father", F.col("parent_id"))
    mother = F.when(F.col("parent_type") == "mother", F.col("parent_id"))
    couples = (
        ties.groupBy(wave, household, "kid_id", "gender", "relatives_list", "relatives_slots")
        .agg(F.min(father).alias("father_id"), F.max(father).alias("__f"),
             F.min(mother).alias("mother_id"), F.max(mother).alias("__m"))
        .filter((F.col("father_id") == F.col("__f")) & (F.col("mother_id") == F.col("__m")))
        .drop("__f", "__m", "gender")
    )
    born = persons.select(F.col("idind").alias("kid_id"), wave, "year", "birth_year").distinct()
    rows = checkpointed(couples.join(born, ["kid_id", wave]))
    group = [wave, "birth_year", "year"]
    # the ambiguous groups are few: found by aggregates, taken out by joins that do not move the rows
    kept = excluding(rows, [*group, "mother_id"], contradictory(rows, [*group, "mother_id"], "father_id"), True)
    kept = excluding(kept, [*group, "father_id"], contradictory(rows, [*group, "father_id"], "mother_id"), True)
    kept = kept.select("year", wave, household, "kid_id", "father_id", "mother_id", "relatives_list",
                       "relatives_slots", "birth_year").distinct()
    return G.entity_min(kept, ["kid_id"], "birth_year", "birth_year", one_per_wave=True)


def contradictory(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keys of the groups with more than one distinct value."""
    return df.groupBy(*keys).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi")).filter(
        F.col("__lo") != F.col("__hi")).select(*keys)


def sibling_order(children: DataFrame, couple: Sequence[str], born: str, out: str = "kid_order",
                  one_per_wave: bool = False) -> DataFrame:
    """Birth order among the children of a couple; equal birth years share a place and leave no gap.

    A child with an unknown birth year stays, without a place.

    Ranked over the distinct birth years of a couple, which are few however many rows the couple has. ``one_per_wave`` says
    that a child has at most one row per survey wave: a couple's rows are then few, too, and a window ranks them directly.
    """
    if one_per_wave:
        place = F.dense_rank().over(Window.partitionBy(*couple).orderBy(F.col(born).asc_nulls_last()))
        return children.withColumn(out, F.when(F.col(born).isNotNull(), place))
    years = children.select(*couple, born).dropna(subset=[born]).distinct()
    ranked = years.withColumn(out, F.dense_rank().over(Window.partitionBy(*couple).orderBy(born)))
    return salted_join(children, ranked, [*couple, born], "left", null_safe=True)


# ------------------------------------------------------------------------------------- observation panel


def known_flags(persons: DataFrame, person: str, time: str, flag: str) -> DataFrame:
    """One row per person: ``first_seen``, ``ever`` (flag reported at any time) and ``first_true``."""
    return persons.groupBy(person).agg(
        F.min(time).alias("first_seen"), F.max(F.coalesce(F.col(flag), F.lit(0))).alias("ever"),
        F.min(F.when(F.col(flag) == 1, F.col(time))).alias("first_true"))


def with_parent_flag(panel: DataFrame, known: DataFrame, parent: str, time: str, out: str,
                     from_first_true: bool = False) -> DataFrame:
    """Add the parent's flag as known at ``time``; rows whose parent was not seen by then are dropped.

    As the flag is the same on all rows of the parent, the as-of match only asks whether the parent was seen in time,
    so an equi-join with one row per parent answers it. ``from_first_true`` applies the other documented rule: true only
    from the first true report onward.
    """
    flags = known.select(F.col(known.columns[0]).alias(parent), "first_seen", "ever", "first_true")
    value = F.col("ever")
    if from_first_true:
        value = F.coalesce((F.col(time) >= F.col("first_true")).cast("int"), F.lit(0))
    return (panel.join(flags, parent).filter(F.col("first_seen") <= F.col(time))
            .withColumn(out, value.cast("int")).drop("first_seen", "ever", "first_true"))


def observation_panel(persons: DataFrame, children: DataFrame, facts: DataFrame, wave: str = "id_w",
                      household: str = "id_h", from_first_true: bool = False) -> DataFrame:
    """Every observation of a child with a known flag, its latest known ties, both parents' flags and household facts.

    ``persons`` needs (idind, year, univ_diploma, gender, age, profession_code, origsm). The facts come from the wave of
    the ties, not of the observation.
    """
    seen = persons.filter(F.col("univ_diploma").isNotNull()).select(
        F.col("idind").alias("kid_id"), F.col("year").alias("obs_year"),
        F.col("univ_diploma").alias("kid_univ_diploma"), "gender", "age", "profession_code", "origsm")
    # a person has few distinct years: no need to cut time
    panel = asof_join(seen, children, ["kid_id"], "obs_year", "year", "inner", few_times=True).drop("year")
    known = known_flags(persons, "idind", "year", "univ_diploma")
    panel = with_parent_flag(panel, known, "father_id", "obs_year", "father_univ_diploma", from_first_true)
    panel = with_parent_flag(panel, known, "mother_id", "obs_year", "mother_univ_diploma", from_first_true)
    panel = panel.join(facts, [wave, household]).withColumnRenamed("obs_year", "year")
    # the group lies within one household roster and holds each child once
    return G.has_other_class(panel, ["year", wave, household, "father_id", "mother_id"], "gender",
                             "other_gender_siblings", small_groups=True)


# --------------------------------------------------------------------------------------- analysis sample


@dataclass(frozen=True)
class SampleRules:
    lower_age: int
    upper_age: int
    size_top: int
    order_top: int
    born_from: int
    lag_age: int
    household_top: int
    sibling_code: int
    dropped_code: int
    other_member_codes: tuple[int, ...]
    qualified_below: int


def lagged_attribute(panel: DataFrame, entity: str, time: str, age: str, max_age: int, value: str, out: str,
                     sample: DataFrame | None = None) -> DataFrame:
    """Value of ``value`` at the entity's latest observation with age <= ``max_age`` not after the row's time."""
    young = panel.filter(F.col(age) <= max_age).select(entity, F.col(value).alias(out), F.col(time).alias(f"{out}_time"))
    # the rows of a sample are few per person
    return asof_join(panel if sample is None else sample, young, [entity], time, f"{out}_time", "left", few_times=sample is not None)


def analysis_sample(panel: DataFrame, seen: DataFrame, rules: SampleRules, excluded: DataFrame | None = None,
                    wave: str = "id_w") -> DataFrame:
    """One row per person: the earliest observation within the age range, with reconciled family variables.

    ``seen`` holds (idind, year, id_h) of all persons and decides who has lived apart from both parents.
    """
    family = ["year", "mother_id", "father_id"]
    panel = checkpointed(panel.drop("relatives_slots"))
    # one aggregate serves the longest list, the reconciled number of children and the hot families
    per_kid = panel.groupBy(*family, "kid_id").agg(
        F.count(F.lit(1)).alias("__rows"), F.max("kid_order").alias("__last"), F.max(A.length(F.col("relatives_list"))).alias("__longest"))
    stats, hot = written_stats(per_kid.groupBy(*family).agg(
        F.sum("__rows").alias("__rows"), F.count("kid_id").alias("__seen"), F.max("__last").alias("__last"),
        F.max("__longest").alias("__longest")), family)
    lists = salted_join(panel.select(*family, "relatives_list"), stats.select(*family, "__longest"), family, "inner", check=False, hot=hot)
    lists = lists.filter(A.length(F.col("relatives_list")) == F.col("__longest")).select(*family, "relatives_list").distinct()
    # the other rows of a person are not needed beyond the family's numbers; a row without a family has none of these
    of_age = panel.drop("relatives_list").dropna(subset=family).filter(F.col("age").between(rules.lower_age, rules.upper_age))
    # one row per person and wave: few rows per person
    rows = of_age.withColumn("__first", F.min("year").over(Window.partitionBy("kid_id"))).filter(
        F.col("year") == F.col("__first")).drop("__first")
    rows = salted_join(rows, stats.drop("__longest"), family, "inner", check=False, hot=hot)
    rows = salted_join(rows, lists, family, "left", check=False, hot=hot)
    listed = A.count_value(F.col("relatives_list"), rules.sibling_code) + 1
    rows = checkpointed(rows.withColumn("kids_num", F.greatest(listed, F.col("__seen"), F.col("__last")).cast("int"))
                        .drop("__seen", "__last"))

    code = F.col("profession_code")
    members = F.greatest(A.length(F.col("relatives_list")) + 1, F.col("kids_num") + 2)
    rows = (
        rows.filter(~A.has_value(F.col("relatives_list"), rules.dropped_code))
        .filter(F.col("birth_year") >= rules.born_from)
        .withColumn("family_id", E.family_key(F.col("father_id"), F.col("mother_id")))
        .withColumn("prof", profession_class(code, rules.qualified_below))
        .withColumn("nuclear_family",
                    F.when(A.has_any(F.col("relatives_list"), rules.other_member_codes), "0").otherwise("1"))
        .withColumn("hh_size", E.top_code(members, rules.household_top))
        .withColumn("kids_num", E.top_code(F.col("kids_num"), rules.size_top))
        .withColumn("kid_order", E.top_code(F.col("kid_order"), rules.order_top))
        .withColumn("birth_year_trunc", E.fixed_bucket(F.col("birth_year"), 5))
        .drop("relatives_list", "profession_code")
    )
    rows = checkpointed(lagged_attribute(panel, "kid_id", "year", "age", rules.lag_age, "totexpr", "lag_expenses", rows))
    apart = apart_together(rows, seen, "kid_id", ["father_id", "mother_id"], "year", "idind", "year", "id_h")
    rows = membership(rows, "kid_id", apart, "is_separated", check=False)
    if excluded is not None:
        rows = excluding(rows, "kid_id", excluded)
    return rows.withColumnRenamed("kid_univ_diploma", "univ_diploma").distinct()


def profession_class(code: Column, qualified_below: int) -> Column:
    """unemployed / qualified / not qualified from an occupation code."""
    return E.choose([(code == -1, "unemployed"), ((code < qualified_below) & (code != 0), "qualified")],
                    "not qualified")


def comparison_population(persons: DataFrame, facts: DataFrame, pairs: DataFrame, lower_age: int, born_from: int,
                          tie: int, wave: str = "id_w", household: str = "id_h") -> DataFrame:
    """The sample's first-qualifying rule applied to everybody, with flags for living with one or both parents."""
    adults = persons.filter((F.col("age") >= lower_age) & (F.col("birth_year") >= born_from))
    first = keep_at_extreme(adults, ["idind"], "year", "min").withColumn(
        "univ_diploma", F.coalesce(F.col("univ_diploma"), F.lit(0)))
    lists = pairs.select(wave, household, F.col("kid_id").alias("idind"), "relatives_list").distinct()
    joined = first.join(facts, [wave, household]).join(lists, [wave, household, "idind"], "left")
    ties = F.col("relatives_list")
    return (
        joined.withColumn("is_separated", F.when(A.has_value(ties, tie), 0).otherwise(1))
        .withColumn("is_full_family_and_not_separated", (A.count_value(ties, tie) == 2).cast("int"))
    )


# ------------------------------------------------------------------------------------- representativeness


def level_shares(df: DataFrame, by: str, entity: str, levels: dict[str, tuple[str, object]]) -> DataFrame:
    """(by, name, share): for each named (column, level) the share of distinct entities at that level.

    All columns are counted in one pass; a class that is absent has share 0.
    """
    parts = F.array(*[F.struct(F.lit(name).alias("name"), F.col(c).cast("string").alias("level"),
                               (F.col(c) == F.lit(level)).alias("hit"))
                      for name, (c, level) in levels.items()])
    rows = df.select(by, entity, F.explode(parts).alias("p")).select(by, entity, "p.name", "p.level", "p.hit").distinct()
    return rows.groupBy(by, "name").agg(F.avg(F.coalesce(F.col("hit").cast("double"), F.lit(0.0))).alias("share"))


def deviations(sample: DataFrame, population: DataFrame, by: str, sample_entity: str, population_entity: str,
               levels: dict[str, tuple[str, object]], out: str = "value") -> DataFrame:
    """Sample share minus population share by period and named class, for every period of the population."""
    ours = level_shares(sample, by, sample_entity, levels).withColumnRenamed("share", "__ours")
    theirs = level_shares(population, by, population_entity, levels)
    return theirs.join(ours, [by, "name"], "left").select(
        by, "name", (F.coalesce(F.col("__ours"), F.lit(0.0)) - F.col("share")).alias(out))


def of_known_families(population: DataFrame, sample: DataFrame, person: str, kid: str, full_family: str) -> DataFrame:
    """``population`` without the people who were seen in a full family but are not in the sample.

    They live with both parents, so that they miss from the sample says that a parent's status is unknown. A person goes
    with all rows, as one row in a full family is enough.
    """
    full = population.filter(F.col(full_family) == 1).select(person).distinct()
    unknown = full.join(sample.select(F.col(kid).alias(person)).distinct(), person, "left_anti")
    return excluding(population, person, unknown)


def deviations_by_group(parts: dict[str, tuple[DataFrame, DataFrame]], by: str, sample_entity: str,
                        population_entity: str, levels: dict[str, tuple[str, object]], label: str) -> DataFrame:
    """``deviations`` for several (sample, population) pairs, stacked with a label."""
    return stacked({k: deviations(s, p, by, sample_entity, population_entity, levels)
                    for k, (s, p) in parts.items()}, label)


# ------------------------------------------------------------------------------------------------- twins


def twins_among_siblings(sample: DataFrame, couple: Sequence[str], order: str) -> DataFrame:
    """All rows of couples with more than one child at the same birth order."""
    pairs = G.groups_of_size(sample, [*couple, order], F.col("n") > 1).select(*couple).distinct()
    return only_members(sample, couple, pairs)


def twin_last_births(people: DataFrame, household: str, person: str, born: str, age: str, gap: int, born_from: int,
                     ages: tuple[int, int]) -> DataFrame:
    """Members born singly up to ``gap`` years before a last birth of exactly two, within an age range.

    Adds ``twin_year``. Everything is derived from one row per household and birth year.
    """
    shared = G.fewer_distinct(people, [household], born, person)
    births = people.groupBy(household, born).agg(F.count(F.lit(1)).alias("__n"))
    last = (
        births.groupBy(household).agg(F.max(F.struct(born, "__n")).alias("__last"))
        .filter(F.col("__last.__n") == 2)
        .select(household, F.col(f"__last.{born}").alias("twin_year"))
        .join(shared, household, "left_semi")
    )
    single = births.filter(F.col("__n") == 1).select(household, born)
    older = single.join(last, household).filter(
        (F.col(born) < F.col("twin_year")) & (F.col("twin_year") - F.col(born) <= gap) & (F.col(born) >= born_from))
    return salted_join(people, older, [household, born], "inner").filter(F.col(age).between(*ages))
