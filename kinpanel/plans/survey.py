"""A household panel made from the order tables, and the composed panel queries on it.

Customers in blocks of five are households: members 1 and 2 are the parents, 3 to 5 their children. A person is observed
in the years of their orders; the answers are arithmetic on the first order of the year, with gaps and contradictions.
The panel has one row per person and year, so everything after that first aggregate is small next to the orders.
"""

from __future__ import annotations

from dataclasses import replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinpanel.functions import arrays as A
from kinpanel.functions import expressions as E
from kinpanel.operators import aggregates as G
from kinpanel.operators import household as H
from kinpanel.operators.reshape import stacked, transpose
from kinpanel.plans.registry import query, table
from kinpanel.session import checkpointed
from kinpanel.sources.tables import columns_by_label
from kinpanel.stats import crosstab as C
from kinpanel.stats.holdout import metric_curve
from kinpanel.stats.logit import fit_specifications, profile_intervals
from kinpanel.stats.specs import coefficient_table, nested_specifications

# Fixed values of the survey's code book.
CHILD_OF, SIBLING, UNCLEAR_ELDER = 4, 6, 3
NOT_NUCLEAR = (1, 2, 7, 9, 10, 11, 12, 13, 14, 15, 16)
ENROLLED_FROM, DEGREE, STUDENT, NO_JOB = 19, 6, 16, 5
RESIDENCE_LEVELS = ["city", "village", "1mln", "MSK", "SPB"]
QUARTILES = ["I Q", "II Q", "III Q", "IV Q"]
HOUSEHOLD_SIZES = ["3", "4", "5", "6", ">=7"]
# Children are at most 35 in these tables, so the sample starts at 20 instead of 22 and births at 1965.
RULES = H.SampleRules(
    lower_age=20, upper_age=250, size_top=4, order_top=3, born_from=1965, lag_age=18, household_top=7,
    sibling_code=SIBLING, dropped_code=UNCLEAR_ELDER, other_member_codes=NOT_NUCLEAR, qualified_below=6)
SLOTS = (1, 2, 3, 4, 5)


# ------------------------------------------------------------------------------------- from raw answers


def prepare_persons(raw: DataFrame) -> DataFrame:
    """Reconciled birth year, three-valued diploma flag and occupation class from raw answers."""
    born = E.fallback(F.col("born_a"), F.col("born_b"), F.col("year") - F.col("age"))
    diploma = E.any_of([
        F.coalesce(F.col("educ"), F.lit(-1)) >= ENROLLED_FROM, F.coalesce(F.col("diplom"), F.lit(-1)) == DEGREE,
        F.coalesce(F.col("diplom_1"), F.lit(-1)) == DEGREE, F.col("j90") == STUDENT])
    job = E.fallback(
        F.col("occup08"), F.when((F.col("j1") == NO_JOB) | F.col("j1").isNull(), F.lit(-1)),
        E.choose([(F.col("j4_2").isNull(), None), (F.col("j4_2").isin(4, 5), 4)], 7))
    answers = raw.withColumns({
        "reported": born.cast("int"), "univ_diploma": E.three_valued(diploma), "profession_code": job.cast("int"),
        "gender": E.choose([(F.col("h5") == 1, "male")], "female"),
    }).drop("educ", "diplom", "diplom_1", "j90", "born_a", "born_b", "occup08", "j1", "j4_2", "h5")
    return G.entity_min(answers, ["idind"], "reported", "birth_year", one_per_wave=True).drop("reported")


def prepare_facts(raw: DataFrame) -> DataFrame:
    """Residence class, presence of elders and expense quartile of the wave for every household-wave."""
    people = F.col("popul")
    residence = E.choose([
        (F.col("status") >= 3, "village"), (people.between(3_000_000, 7_000_000), "SPB"), (people >= 8_000_000, "MSK"),
        (people >= 1_000_000, "1mln")], "city")
    banded = G.quantile_band(raw, ["id_w"], "totexpr", "__band", QUARTILES)
    return banded.select("id_w", "id_h", residence.alias("residence"),
                         E.count_sum(F.col("ncat5"), F.col("ncat6")).cast("int").alias("elders_presence"),
                         F.col("__band").alias("totexpr"))


# ------------------------------------------------------------------------------------ from the order tables


def raw_persons(spark, sf) -> DataFrame:
    """One row per person and year with raw answers."""
    obs = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("idind"), F.year("o_orderdate").alias("year")).agg(
        F.min("o_orderkey").alias("k"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))
    k, hh, slot = F.col("k"), F.floor(F.col("idind") / 5), (F.col("idind") % 5 + 1).cast("int")
    obs = obs.withColumns({"hh": hh, "slot": slot})
    child = F.col("slot") >= 3
    born = F.when(child, 1966 + (F.col("idind") * 7) % 18).otherwise(1935 + F.col("idind") % 11)
    moved = child & (k % 7 == 0)
    same_sex = F.col("hh") % 50 == 7
    unborn = F.col("idind") % 97 == 50  # nothing is known about their birth

    def unless(gap: Column, value: Column) -> Column:
        return F.when(~gap, value.cast("int"))

    return obs.withColumn("__born", born).select(
        "idind", "year", (F.col("year") - 1990).alias("id_w"), "slot", "cents",
        (F.col("hh") * 10 + F.when(moved, F.col("slot")).otherwise(0)).alias("id_h"),
        unless(unborn, F.col("year") - F.col("__born")).alias("age"),
        E.choose([(F.col("slot") == 1, F.lit(1)), (F.col("slot") == 2, F.when(same_sex, 1).otherwise(2))],
                 (F.col("hh") + F.col("slot")) % 2 + 1).cast("int").alias("h5"),
        unless((k % 3 == 0) | unborn, F.col("__born") + F.when(k % 13 == 0, 1).otherwise(0)).alias("born_a"),
        unless((k % 2 == 0) | unborn, F.col("__born")).alias("born_b"),
        unless(k % 4 == 1, (k * 3) % 23).alias("educ"), unless(k % 3 == 1, k % 9).alias("diplom"),
        unless(k % 5 == 2, k % 11).alias("diplom_1"), unless(k % 5 == 0, k % 19).alias("j90"),
        unless(k % 11 == 10, k % 11).alias("occup08"), unless(k % 6 == 0, k % 6).alias("j1"),
        unless(k % 8 == 0, k % 8).alias("j4_2"), F.when(k % 4 == 0, 0).otherwise(1).alias("origsm"))


def raw_facts(raw: DataFrame) -> DataFrame:
    spent = raw.groupBy("id_w", "id_h").agg(F.sum("cents").alias("cents"))
    hh = F.floor(F.col("id_h") / 10)
    return spent.select(
        "id_w", "id_h", F.when(F.col("cents") % 17 != 0, F.col("cents")).alias("totexpr"),
        ((hh * 37) % 10 * 1_000_000).alias("popul"), (hh % 4 + 1).alias("status"),
        F.nullif(hh % 3, F.lit(0)).alias("ncat5"), F.nullif(hh % 2, F.lit(1)).alias("ncat6"))


def relation_code(i: int, j: int, hh: Column) -> Column:
    """How member i is related to member j."""
    usual = {(True, True): SIBLING, (True, False): CHILD_OF, (False, True): 2, (False, False): 1}[(i >= 3, j >= 3)]
    rules: list[E.Rule] = []
    if 5 in (i, j):
        rules.append((hh % 17 == 4, 13))
    if (i, j) in ((3, 5), (5, 3)):
        rules.append((hh % 23 == 6, CHILD_OF if i == 3 else 2))
    if (i, j) == (3, 4):
        rules.append((hh % 29 == 5, UNCLEAR_ELDER))
    return E.choose(rules, usual) if rules else F.lit(usual)


def raw_roster(raw: DataFrame) -> DataFrame:
    """Wide roster: one row per household-wave, columns per member slot and pair of slots; both name spellings occur."""
    cells = []
    for i in SLOTS:
        here = F.col("slot") == i
        cells += [F.max(F.when(here, F.col("idind"))).alias(f"idind{i}"), F.max(F.when(here, F.col("h5"))).alias(f"b{i}.5")]
    members = raw.groupBy("id_w", "id_h").agg(*cells)
    hh = F.floor(F.col("id_h") / 10)
    grid = {}
    for i in SLOTS:
        for j in SLOTS:
            if i != j:
                both = F.col(f"idind{i}").isNotNull() & F.col(f"idind{j}").isNotNull()
                name = f"b{i}.9.{j}" if i < j else f"b{i}.9{j}"
                grid[name] = F.when(both, relation_code(i, j, hh))
    return members.withColumns(grid)


def roster_dictionary(spark) -> DataFrame:
    """Labels of the roster columns; one column is listed that the file lacks."""
    rows = [(f"number of person {i}", f"idind{i}") for i in (*SLOTS, 6)]
    rows += [(f"gender of person {i}", f"b{i}.5") for i in SLOTS]
    rows += [(f"relation of person {i} to person {j}", f"b{i}.9.{j}" if i < j else f"b{i}.9{j}")
             for i in SLOTS for j in SLOTS if i != j]
    listed_rows = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(c).alias("code")) for n, c in rows])
    return spark.range(1).select(F.explode(listed_rows).alias("r")).select("r.*")


class SurveyTables:
    """The inputs that travel together between the stages, each made when first asked for.

    Stages read persons and facts several times, so these are written once.
    """

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def raw(self) -> DataFrame:
        return checkpointed(raw_persons(self.spark, self.sf_dir))

    @cached_property
    def persons(self) -> DataFrame:
        return checkpointed(prepare_persons(self.raw))

    @cached_property
    def facts(self) -> DataFrame:
        return checkpointed(prepare_facts(raw_facts(self.raw)))

    @cached_property
    def pairs(self) -> DataFrame:
        """Written, as the sample and the population it is compared with both read it."""
        return checkpointed(self.read_pairs())

    def read_pairs(self) -> DataFrame:
        roster = raw_roster(self.raw)
        words = roster_dictionary(self.spark)
        pick = [columns_by_label(words, p, roster.columns) for p in ("^relation of", "^number of", "^gender of")]
        return H.relation_pairs(roster, ["id_w", "id_h"], *pick)


def anomalies(spark, sf) -> DataFrame:
    """Persons with known false ties."""
    return table(spark, sf, "customer").filter(F.col("c_acctbal") < -900).select("c_custkey")


def parents(spark, sf, tables: SurveyTables) -> DataFrame:
    return H.assign_parents(tables.pairs, tables.persons, CHILD_OF, excluded=anomalies(spark, sf))


def panel_of(spark, sf, tables: SurveyTables) -> DataFrame:
    children = H.sibling_order(parents(spark, sf, tables), ["father_id", "mother_id"], "birth_year", one_per_wave=True)
    return H.observation_panel(tables.persons, children, tables.facts)


def sample_of(spark, sf, tables: SurveyTables, rules: H.SampleRules = RULES) -> DataFrame:
    panel = panel_of(spark, sf, tables)
    sample = H.analysis_sample(panel, tables.persons, rules)
    mothers = tables.persons.select(F.col("idind").alias("mother_id"), F.col("birth_year").alias("mother_born")).distinct()
    return (sample.join(mothers, "mother_id")
            .withColumn("mother_birth_year_trunc", E.fixed_bucket(F.col("mother_born"), 10)).drop("mother_born"))


def listed(df: DataFrame) -> DataFrame:
    """Lists as text."""
    return df.withColumns({c: A.joined(F.col(c)) for c in ("relatives_list", "relatives_slots") if c in df.columns})


# ------------------------------------------------------------------------------------------ the same in SQL


PANEL_SQL = """
WITH obs AS (
  SELECT o_custkey AS idind, CAST(year(o_orderdate) AS INTEGER) AS year, min(o_orderkey) AS k,
         CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents,
         o_custkey // 5 AS hh, CAST(o_custkey % 5 + 1 AS INTEGER) AS slot,
         CASE WHEN o_custkey % 97 = 50 THEN NULL WHEN o_custkey % 5 >= 2 THEN 1966 + (o_custkey * 7) % 18
              ELSE 1935 + o_custkey % 11 END AS born
  FROM orders GROUP BY o_custkey, year(o_orderdate)),
raw AS (
  SELECT idind, year, year - 1990 AS id_w, slot, cents, hh,
         hh * 10 + CASE WHEN slot >= 3 AND k % 7 = 0 THEN slot ELSE 0 END AS id_h,
         CAST(year - born AS INTEGER) AS age,
         CASE WHEN slot = 1 THEN 1 WHEN slot = 2 THEN CASE WHEN hh % 50 = 7 THEN 1 ELSE 2 END ELSE (hh + slot) % 2 + 1 END AS h5,
         coalesce(CASE WHEN k % 3 <> 0 THEN born + CASE WHEN k % 13 = 0 THEN 1 ELSE 0 END END,
                  CASE WHEN k % 2 <> 0 THEN born END, year - (year - born)) AS reported,
         CASE WHEN k % 4 = 1 THEN NULL ELSE (k * 3) % 23 END AS educ, CASE WHEN k % 3 = 1 THEN NULL ELSE k % 9 END AS diplom,
         CASE WHEN k % 5 = 2 THEN NULL ELSE k % 11 END AS diplom_1, CASE WHEN k % 5 = 0 THEN NULL ELSE k % 19 END AS j90,
         CASE WHEN k % 11 = 10 THEN NULL ELSE k % 11 END AS occup08, CASE WHEN k % 6 = 0 THEN NULL ELSE k % 6 END AS j1,
         CASE WHEN k % 8 = 0 THEN NULL ELSE k % 8 END AS j4_2, CASE WHEN k % 4 = 0 THEN 0 ELSE 1 END AS origsm
  FROM obs),
persons AS (
  SELECT idind, year, id_w, slot, id_h, age, origsm, CASE WHEN h5 = 1 THEN 'male' ELSE 'female' END AS gender,
         CAST(min(reported) OVER (PARTITION BY idind) AS INTEGER) AS birth_year,
         CASE WHEN coalesce(educ, -1) >= 19 OR coalesce(diplom, -1) = 6 OR coalesce(diplom_1, -1) = 6 OR j90 = 16 THEN 1
              WHEN j90 IS NULL THEN NULL ELSE 0 END AS univ_diploma,
         CAST(coalesce(occup08, CASE WHEN j1 = 5 OR j1 IS NULL THEN -1 END,
                       CASE WHEN j4_2 IS NULL THEN NULL WHEN j4_2 IN (4, 5) THEN 4 ELSE 7 END) AS INTEGER) AS profession_code,
         h5, hh
  FROM raw),
spent AS (SELECT id_w, id_h, id_h // 10 AS hh, nullif(sum(cents), CASE WHEN sum(cents) % 17 = 0 THEN sum(cents) END) AS e
          FROM raw GROUP BY 1, 2),
cuts AS (SELECT id_w, quantile_cont(e, 0.25) AS a, quantile_cont(e, 0.5) AS b, quantile_cont(e, 0.75) AS c FROM spent GROUP BY 1),
facts AS (
  SELECT s.id_w, s.id_h,
         CASE WHEN hh % 4 + 1 >= 3 THEN 'village' WHEN (hh * 37) % 10 BETWEEN 3 AND 7 THEN 'SPB'
              WHEN (hh * 37) % 10 >= 8 THEN 'MSK' WHEN (hh * 37) % 10 >= 1 THEN '1mln' ELSE 'city' END AS residence,
         CAST(coalesce(nullif(hh % 3, 0) + nullif(hh % 2, 1), 0) AS INTEGER) AS elders_presence,
         CASE WHEN e <= a THEN 'I Q' WHEN e <= b THEN 'II Q' WHEN e <= c THEN 'III Q' WHEN e IS NOT NULL THEN 'IV Q' END AS totexpr
  FROM spent s JOIN cuts USING (id_w)),
ties AS (
  SELECT a.id_w, a.id_h, a.slot AS kid_slot, b.slot AS parent_slot, a.idind AS kid_id, b.idind AS parent_id, a.gender,
         CASE WHEN b.h5 = 1 THEN 'father' ELSE 'mother' END AS parent_type,
         CASE WHEN 5 IN (a.slot, b.slot) AND a.hh % 17 = 4 THEN 13
              WHEN a.slot = 3 AND b.slot = 5 AND a.hh % 23 = 6 THEN 4 WHEN a.slot = 5 AND b.slot = 3 AND a.hh % 23 = 6 THEN 2
              WHEN a.slot = 3 AND b.slot = 4 AND a.hh % 29 = 5 THEN 3
              WHEN a.slot >= 3 AND b.slot >= 3 THEN 6 WHEN a.slot >= 3 THEN 4 WHEN b.slot >= 3 THEN 2 ELSE 1 END AS value
  FROM persons a JOIN persons b ON a.id_w = b.id_w AND a.id_h = b.id_h AND a.slot <> b.slot),
pairs AS (
  SELECT *, list(value) OVER w AS relatives_list, list(parent_slot) OVER w AS relatives_slots
  FROM ties WINDOW w AS (PARTITION BY id_w, id_h, kid_slot ORDER BY parent_slot
                         ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
couples AS (
  SELECT id_w, id_h, kid_id, any_value(relatives_list) AS relatives_list, any_value(relatives_slots) AS relatives_slots,
         min(parent_id) FILTER (WHERE parent_type = 'father') AS father_id,
         min(parent_id) FILTER (WHERE parent_type = 'mother') AS mother_id
  FROM pairs WHERE value = 4 AND kid_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < -900)
  GROUP BY 1, 2, 3
  HAVING count(DISTINCT parent_id) FILTER (WHERE parent_type = 'father') = 1
     AND count(DISTINCT parent_id) FILTER (WHERE parent_type = 'mother') = 1),
born AS (SELECT c.*, p.year, p.birth_year FROM couples c JOIN persons p ON p.idind = c.kid_id AND p.id_w = c.id_w),
sure AS (
  SELECT b.* FROM born b
  WHERE (SELECT count(DISTINCT x.father_id) FROM born x WHERE x.id_w = b.id_w AND x.birth_year IS NOT DISTINCT FROM b.birth_year
         AND x.mother_id = b.mother_id) = 1
    AND (SELECT count(DISTINCT x.mother_id) FROM born x WHERE x.id_w = b.id_w AND x.birth_year IS NOT DISTINCT FROM b.birth_year
         AND x.father_id = b.father_id) = 1),
children AS (
  SELECT year, id_w, id_h, kid_id, father_id, mother_id, relatives_list, relatives_slots,
         CAST(min(birth_year) OVER (PARTITION BY kid_id) AS INTEGER) AS birth_year FROM sure),
ordered AS (
  SELECT *, CASE WHEN birth_year IS NOT NULL THEN CAST(dense_rank() OVER (PARTITION BY father_id, mother_id ORDER BY birth_year NULLS LAST)
         AS INTEGER) END AS kid_order FROM children),
known AS (SELECT idind, min(year) AS first_seen, max(coalesce(univ_diploma, 0)) AS ever FROM persons GROUP BY 1),
latest AS (
  SELECT p.idind AS kid_id, p.year, p.univ_diploma AS kid_univ_diploma, p.gender, p.age, p.profession_code, p.origsm,
         o.id_w, o.id_h, o.father_id, o.mother_id, o.relatives_list, o.relatives_slots, o.birth_year, o.kid_order
  FROM persons p JOIN ordered o ON o.kid_id = p.idind AND o.year <= p.year
  WHERE p.univ_diploma IS NOT NULL
  QUALIFY rank() OVER (PARTITION BY p.idind, p.year ORDER BY o.year DESC) = 1),
panel AS (
  SELECT l.*, f.ever AS father_univ_diploma, m.ever AS mother_univ_diploma, residence, elders_presence, totexpr,
         CASE WHEN list_contains(list(l.gender) OVER (PARTITION BY l.year, l.id_w, l.id_h, father_id, mother_id),
                                 CASE WHEN l.gender = 'male' THEN 'female' ELSE 'male' END) THEN 1 ELSE 0 END AS other_gender_siblings
  FROM latest l JOIN known f ON f.idind = l.father_id AND f.first_seen <= l.year
  JOIN known m ON m.idind = l.mother_id AND m.first_seen <= l.year
  JOIN facts ON facts.id_w = l.id_w AND facts.id_h = l.id_h),
longest AS (
  SELECT DISTINCT year, father_id, mother_id, relatives_list FROM panel
  QUALIFY len(relatives_list) = max(len(relatives_list)) OVER (PARTITION BY year, father_id, mother_id)),
sizes AS (SELECT year, father_id, mother_id, count(DISTINCT kid_id) AS n2, max(kid_order) AS n3 FROM panel GROUP BY 1, 2, 3),
sized AS (
  SELECT p.* EXCLUDE (relatives_list, relatives_slots), l.relatives_list,
         greatest(len(list_filter(l.relatives_list, lambda x: x = 6)) + 1, n2, n3) AS kids
  FROM panel p LEFT JOIN longest l USING (year, father_id, mother_id) JOIN sizes USING (year, father_id, mother_id)),
first AS (SELECT * FROM sized WHERE age BETWEEN 20 AND 250 QUALIFY year = min(year) OVER (PARTITION BY kid_id)),
young AS (SELECT kid_id, year AS lag_year, totexpr AS lag_expenses FROM panel WHERE age <= 18),
lagged AS (
  SELECT f.kid_id, f.year, y.lag_expenses, y.lag_year FROM (SELECT DISTINCT kid_id, year FROM first) f
  JOIN young y ON y.kid_id = f.kid_id AND y.lag_year <= f.year
  QUALIFY rank() OVER (PARTITION BY f.kid_id, f.year ORDER BY y.lag_year DESC) = 1),
apart AS (
  SELECT DISTINCT f.kid_id FROM first f JOIN persons k ON k.idind = f.kid_id AND k.year <= f.year
  JOIN persons d ON d.idind = f.father_id AND d.year = k.year AND d.id_h <> k.id_h
  JOIN persons m ON m.idind = f.mother_id AND m.year = k.year AND m.id_h <> k.id_h),
sample AS (
  SELECT DISTINCT f.year, f.id_w, f.id_h, f.kid_id, f.father_id, f.mother_id, gender, age, origsm, birth_year,
         CAST(birth_year // 5 * 5 AS INTEGER) AS birth_year_trunc, kid_univ_diploma AS univ_diploma,
         father_univ_diploma, mother_univ_diploma,
         CASE WHEN kids >= 4 THEN '>=4' ELSE CAST(kids AS VARCHAR) END AS kids_num,
         CASE WHEN kid_order >= 3 THEN '>=3' ELSE CAST(kid_order AS VARCHAR) END AS kid_order,
         CASE WHEN list_has_any(relatives_list, [1, 2, 7, 9, 10, 11, 12, 13, 14, 15, 16]) THEN '0' ELSE '1' END AS nuclear_family,
         CASE WHEN greatest(len(relatives_list) + 1, kids + 2) >= 7 THEN '>=7'
              ELSE CAST(greatest(len(relatives_list) + 1, kids + 2) AS VARCHAR) END AS hh_size,
         residence, elders_presence, totexpr, lag_expenses, lag_year, other_gender_siblings,
         CASE WHEN f.kid_id IN (SELECT kid_id FROM apart) THEN 1 ELSE 0 END AS is_separated,
         CASE WHEN profession_code = -1 THEN 'unemployed' WHEN profession_code < 6 AND profession_code <> 0 THEN 'qualified'
              ELSE 'not qualified' END AS prof,
         f.father_id || '_' || f.mother_id AS family_id,
         CAST((SELECT min(p.birth_year) FROM persons p WHERE p.idind = f.mother_id) // 10 * 10 AS INTEGER) AS mother_birth_year_trunc
  FROM first f LEFT JOIN lagged g ON g.kid_id = f.kid_id AND g.year = f.year
  WHERE NOT list_contains(relatives_list, 3) AND birth_year >= 1965),
everyone AS (
  SELECT * FROM persons WHERE age >= 20 AND birth_year >= 1965 QUALIFY year = min(year) OVER (PARTITION BY idind)),
lists AS (SELECT DISTINCT id_w, id_h, kid_id, relatives_list FROM pairs),
population AS (
  SELECT e.idind, e.year, e.id_w, e.id_h, e.age, e.gender, coalesce(e.univ_diploma, 0) AS univ_diploma, e.origsm, residence,
         CASE WHEN e.profession_code = -1 THEN 'unemployed' WHEN e.profession_code < 6 AND e.profession_code <> 0
              THEN 'qualified' ELSE 'not qualified' END AS prof,
         CASE WHEN coalesce(list_contains(relatives_list, 4), false) THEN 0 ELSE 1 END AS is_separated,
         CASE WHEN coalesce(len(list_filter(relatives_list, lambda x: x = 4)), 0) = 2 THEN 1 ELSE 0 END
           AS is_full_family_and_not_separated
  FROM everyone e JOIN facts f ON f.id_w = e.id_w AND f.id_h = e.id_h
  LEFT JOIN lists l ON l.id_w = e.id_w AND l.id_h = e.id_h AND l.kid_id = e.idind)
"""


# ------------------------------------------------------------------------------------------------- queries


@query("relation_pairs", PANEL_SQL + """
SELECT id_w, id_h, value, kid_id, gender, parent_id, parent_type, list_aggregate(relatives_list, 'string_agg', ',') AS relatives_list,
       list_aggregate(relatives_slots, 'string_agg', ',') AS relatives_slots FROM pairs""")
def relation_pairs(spark, sf):
    return listed(SurveyTables(spark, sf).read_pairs())


@query("parent_assignment", PANEL_SQL + """
SELECT year, id_w, id_h, kid_id, father_id, mother_id, birth_year, list_aggregate(relatives_list, 'string_agg', ',') AS relatives_list,
       list_aggregate(relatives_slots, 'string_agg', ',') AS relatives_slots FROM children""")
def parent_assignment(spark, sf):
    return listed(parents(spark, sf, SurveyTables(spark, sf)))


@query("observation_panel", PANEL_SQL + """
SELECT kid_id, year, kid_univ_diploma, gender, age, profession_code, origsm, id_w, id_h, father_id, mother_id, birth_year,
       kid_order, father_univ_diploma, mother_univ_diploma, residence, elders_presence, totexpr, other_gender_siblings,
       list_aggregate(relatives_list, 'string_agg', ',') AS relatives_list,
       list_aggregate(relatives_slots, 'string_agg', ',') AS relatives_slots FROM panel""")
def observation_panel(spark, sf):
    return listed(panel_of(spark, sf, SurveyTables(spark, sf)))


@query("analysis_sample", PANEL_SQL + "SELECT * RENAME (lag_year AS lag_expenses_time) FROM sample")
def analysis_sample(spark, sf):
    return sample_of(spark, sf, SurveyTables(spark, sf))


def population_of(tables: SurveyTables) -> DataFrame:
    people = H.comparison_population(tables.persons, tables.facts, tables.pairs, RULES.lower_age, RULES.born_from,
                                     CHILD_OF)
    return people.withColumn("prof", H.profession_class(F.col("profession_code"), RULES.qualified_below)).select(
        "idind", "year", "id_w", "id_h", "age", "gender", "univ_diploma", "origsm", "residence", "prof", "is_separated",
        "is_full_family_and_not_separated")


@query("comparison_population", PANEL_SQL + "SELECT * FROM population")
def comparison_population(spark, sf):
    return population_of(SurveyTables(spark, sf))


def _class_rows(source: str, entity: str) -> str:
    """Distinct (entity, class) rows of both comparisons in SQL."""
    tests = [("village", "residence", "residence = 'village'"), ("no_diploma", "CAST(univ_diploma AS VARCHAR)",
             "univ_diploma = 0"), ("male", "gender", "gender = 'male'")]
    return " UNION ALL ".join(
        f"SELECT DISTINCT '{label}' AS is_separated, '{name}' AS name, year, {entity} AS id, {level} AS level, "
        f"CAST({hit} AS INTEGER) AS hit FROM {source} WHERE {keep}"
        for label, keep in (("all", "true"), ("not_separated", "is_separated = 0")) for name, level, hit in tests)


PANEL_CLASSES = {"village": ("residence", "village"), "no_diploma": ("univ_diploma", 0), "male": ("gender", "male")}


_YEARS = PANEL_SQL + """,
pop AS (SELECT * FROM population WHERE origsm = 1 AND age <= 26), sam AS (SELECT * FROM sample WHERE age <= 26),
years AS (SELECT is_separated, name, year, avg(hit) AS share FROM (
  """ + _class_rows("pop", "idind") + """) GROUP BY ALL),
ours AS (SELECT is_separated, name, year, avg(hit) AS share FROM (
  """ + _class_rows("sam", "kid_id") + """) GROUP BY ALL),
apart_by_year AS (SELECT is_separated, year, name, coalesce(o.share, 0) - y.share AS value
                  FROM years y LEFT JOIN ours o USING (is_separated, year, name))
"""
PERIOD = 3


def deviations(spark, sf, known_families: bool = False) -> DataFrame:
    """Share differences between the analysis sample and the comparable population, all and not separated.

    ``known_families`` leaves people in full families out of the population if their parents' status is not known.
    """
    tables = SurveyTables(spark, sf)
    people = population_of(tables).filter((F.col("origsm") == 1) & (F.col("age") <= 26))
    sample = checkpointed(sample_of(spark, sf, tables))
    if known_families:
        people = H.of_known_families(checkpointed(people), sample, "idind", "kid_id", "is_full_family_and_not_separated")
    people, sample = checkpointed(people), sample.filter(F.col("age") <= 26)
    at_home = F.col("is_separated") == 0
    parts = {"all": (sample, people), "not_separated": (sample.filter(at_home), people.filter(at_home))}
    return H.deviations_by_group(parts, "year", "kid_id", "idind", PANEL_CLASSES, "is_separated")


@query("panel_deviation", _YEARS + "SELECT is_separated, year, name, round(value, 6) AS value FROM apart_by_year")
def panel_deviation(spark, sf):
    return deviations(spark, sf).withColumn("value", F.round("value", 6))


@query("panel_deviation_by_period", _YEARS + f"""SELECT is_separated, CAST(year // {PERIOD} * {PERIOD} AS INTEGER) AS period, name,
  round(avg(value), 6) AS value FROM apart_by_year GROUP BY ALL""")
def panel_deviation_by_period(spark, sf):
    """The yearly differences averaged over periods."""
    rows = deviations(spark, sf).withColumn("period", (F.floor(F.col("year") / PERIOD) * PERIOD).cast("int"))
    return rows.groupBy("is_separated", "period", "name").agg(F.round(F.avg("value"), 6).alias("value"))


_KNOWN = _YEARS.replace("pop AS (SELECT * FROM population WHERE origsm = 1 AND age <= 26)", """pop_all AS (
  SELECT * FROM population WHERE origsm = 1 AND age <= 26),
pop AS (SELECT * FROM pop_all WHERE idind NOT IN (SELECT idind FROM pop_all WHERE is_full_family_and_not_separated = 1
                                                  AND idind NOT IN (SELECT kid_id FROM sample)))""")


@query("panel_deviation_known_families", _KNOWN + "SELECT is_separated, year, name, round(value, 6) AS value FROM apart_by_year")
def panel_deviation_known_families(spark, sf):
    """The yearly differences without people in full families whose parents' status is unknown."""
    return deviations(spark, sf, known_families=True).withColumn("value", F.round("value", 6))


# No number of children or place among them is cut off here.
UNCUT = replace(RULES, size_top=300, order_top=300)


@query("panel_twins", PANEL_SQL.replace("kids >= 4 THEN '>=4'", "kids >= 300 THEN '>=300'").replace("kid_order >= 3 THEN '>=3'", "kid_order >= 300 THEN '>=300'") + """,
twins AS (SELECT DISTINCT father_id, mother_id FROM (
  SELECT father_id, mother_id, kid_order, count(*) AS n FROM sample GROUP BY ALL) WHERE n > 1)
SELECT s.kid_id, s.year, s.father_id, s.mother_id, s.kids_num, s.kid_order, s.birth_year FROM sample s
JOIN twins t ON t.father_id = s.father_id AND t.mother_id = s.mother_id""")
def panel_twins(spark, sf):
    """Everybody of the sample whose parents have two or more children at one place of the birth order."""
    sample = checkpointed(sample_of(spark, sf, SurveyTables(spark, sf), UNCUT))
    return H.twins_among_siblings(sample, ["father_id", "mother_id"], "kid_order").select(
        "kid_id", "year", "father_id", "mother_id", "kids_num", "kid_order", "birth_year")


CROSSED = ["kids_num", "kid_order", "gender", "residence", "parents"]


def described(spark, sf) -> DataFrame:
    """The sample with the parents' education as one variable."""
    mother, father = F.col("mother_univ_diploma") == 1, F.col("father_univ_diploma") == 1
    return checkpointed(sample_of(spark, sf, SurveyTables(spark, sf)).withColumn(
        "parents", E.choose([(mother & father, "both"), (mother, "mother"), (father, "father")], "none")))


@query("panel_crosstab", PANEL_SQL + """,
people AS (SELECT *, CASE WHEN mother_univ_diploma + father_univ_diploma = 2 THEN 'both' WHEN mother_univ_diploma = 1 THEN 'mother'
                          WHEN father_univ_diploma = 1 THEN 'father' ELSE 'none' END AS parents FROM sample),
long AS (SELECT CAST(univ_diploma AS VARCHAR) AS class, unnest(['kids_num', 'kid_order', 'gender', 'residence', 'parents']) AS variable,
                unnest([kids_num, kid_order, gender, residence, parents]) AS level FROM people),
counts AS (SELECT variable, level, class, count(*) AS n FROM long WHERE level IS NOT NULL GROUP BY 1, 2, 3),
every AS (SELECT * FROM counts UNION ALL SELECT variable, level, 'Total', sum(n) FROM counts GROUP BY 1, 2),
moments AS (SELECT CAST(univ_diploma AS VARCHAR) AS class, avg(age) AS m, stddev_samp(age) AS s FROM people GROUP BY 1
            UNION ALL SELECT 'Total', avg(age), stddev_samp(age) FROM people),
m AS (SELECT *, sum(n) OVER (PARTITION BY variable) AS t, sum(n) OVER (PARTITION BY variable, level) AS r,
             sum(n) OVER (PARTITION BY variable, class) AS c FROM counts),
grid AS (SELECT variable, sum(n ^ 2 / (r * c)) AS q, any_value(t) AS t FROM m GROUP BY variable)
SELECT variable, level, class, CAST(n AS BIGINT) || ' (' || regexp_replace(CAST(round(n * 100.0::DOUBLE
       / sum(n) OVER (PARTITION BY variable, class), 1) AS VARCHAR), '\\.0$', '') || ')' AS text, round(t * (q - 1), 4) AS chi_square
FROM every JOIN grid USING (variable)
UNION ALL SELECT 'age', 'Mean (SD)', class, regexp_replace(CAST(round(m, 1) AS VARCHAR), '\\.0$', '') || ' ('
       || regexp_replace(CAST(round(s, 1) AS VARCHAR), '\\.0$', '') || ')', NULL FROM moments""")
def panel_crosstab(spark, sf):
    """The sample described by diploma, with the parents' education as one variable and the test statistic of each."""
    people = described(spark, sf)
    tests = C.chi_square(C.class_counts(people, "univ_diploma", CROSSED)).select(
        F.col("variable").alias("__v"), F.round("statistic", 4).alias("chi_square"))
    text = C.summary_crosstab(people, "univ_diploma", CROSSED, ["age"])
    # one row per variable
    return text.join(tests, F.col("variable") == F.col("__v"), "left").drop("__v")


# The tails of chi-square and of Student's t come from sums over their densities, with the square root of the first.
@query("panel_descriptives", PANEL_SQL + """,
people AS (SELECT *, CASE WHEN mother_univ_diploma + father_univ_diploma = 2 THEN 'both' WHEN mother_univ_diploma = 1 THEN 'mother'
                          WHEN father_univ_diploma = 1 THEN 'father' ELSE 'none' END AS parents FROM sample),
long AS (SELECT gender AS class, unnest(['kids_num', 'kid_order', 'residence', 'parents', 'hh_size', 'univ_diploma']) AS variable,
                unnest([kids_num, kid_order, residence, parents, hh_size, CAST(univ_diploma AS VARCHAR)]) AS level FROM people),
counts AS (SELECT variable, level, class, count(*) AS n FROM long WHERE level IS NOT NULL GROUP BY 1, 2, 3),
every AS (SELECT * FROM counts UNION ALL SELECT variable, level, 'Total', sum(n) FROM counts GROUP BY 1, 2),
numbers AS (SELECT gender AS class, unnest(['age', 'birth_year']) AS variable, unnest([age, birth_year]) AS v FROM people),
moments AS (SELECT variable, class, avg(v) AS m, stddev_samp(v) AS s FROM numbers GROUP BY 1, 2
            UNION ALL SELECT variable, 'Total', avg(v), stddev_samp(v) FROM numbers GROUP BY 1),
g AS (SELECT *, sum(n) OVER (PARTITION BY variable) AS t, sum(n) OVER (PARTITION BY variable, level) AS r,
             sum(n) OVER (PARTITION BY variable, class) AS c FROM counts),
q AS (SELECT variable, sqrt(greatest(any_value(t) * (sum(n ^ 2 / (r * c)) - 1), 0)) AS s,
             (count(DISTINCT level) - 1) * (count(DISTINCT class) - 1) AS k FROM g GROUP BY variable),
x AS (SELECT (i + 0.5::DOUBLE) / 100000 AS u FROM range(100000) r(i)),
sides AS (SELECT variable, class, count(v) AS n, avg(v) AS m, var_samp(v) / count(v) AS q FROM numbers GROUP BY 1, 2),
w AS (SELECT a.variable, abs(a.m - b.m) / sqrt(a.q + b.q) AS t, (a.q + b.q) ^ 2 / (a.q ^ 2 / (a.n - 1) + b.q ^ 2 / (b.n - 1)) AS k
      FROM sides a JOIN sides b ON a.variable = b.variable AND a.class = 'female' AND b.class = 'male'),
p AS (SELECT variable, 1 - sum(s * (s * u) ^ (k - 1) * exp(-0.5 * (s * u) ^ 2)) / sum(40 * (40 * u) ^ (k - 1) * exp(-0.5 * (40 * u) ^ 2)) AS p
      FROM q, x GROUP BY variable
      UNION ALL SELECT variable, 1 - sum(t * exp(-(k + 1) / 2 * ln(1 + (t * u) ^ 2 / k)))
                                     / sum(60 * exp(-(k + 1) / 2 * ln(1 + (60 * u) ^ 2 / k))) FROM w, x GROUP BY variable)
SELECT variable, level, class, CAST(n AS BIGINT) || ' (' || regexp_replace(CAST(round(n * 100.0::DOUBLE
       / sum(n) OVER (PARTITION BY variable, class), 1) AS VARCHAR), '\\.0$', '') || ')' AS text, round(p, 4) AS p
FROM every JOIN p USING (variable)
UNION ALL SELECT variable, 'Mean (SD)', class, regexp_replace(CAST(round(m, 1) AS VARCHAR), '\\.0$', '') || ' ('
       || regexp_replace(CAST(round(s, 1) AS VARCHAR), '\\.0$', '') || ')', round(p, 4) FROM moments JOIN p USING (variable)""")
def panel_descriptives(spark, sf):
    """The sample described by gender, with the p-value of every variable, numeric ones included."""
    found = C.summary_with_tests(described(spark, sf), "gender", ["kids_num", "kid_order", "residence", "parents", "hh_size", "univ_diploma"],
                                 ["age", "birth_year"], ("female", "male"))
    return found.withColumn("p", F.round("p", 4))


# ------------------------------------------------------------------------------------------- models on it


MODEL_GROUPS = {
    "kids_num": "kids_num", "kid_order": "kid_order", "gender": "gender", "birth_year_trunc": "birth_year_trunc",
    "parents_education": ["mother_univ_diploma", "father_univ_diploma"], "other_gender_siblings": "other_gender_siblings",
    "is_nuclear_family": "nuclear_family", "residence": "residence", "lag_expenses": "lag_expenses"}
OPTIONAL = ["is_separated", "birth_year_trunc"]
MODEL_LEVELS = {
    "is_separated": [0, 1], "kids_num": E.top_code_levels(RULES.size_top), "kid_order": E.top_code_levels(RULES.order_top),
    "gender": ["female", "male"], "birth_year_trunc": list(range(1965, 1985, 5)), "mother_univ_diploma": [0, 1],
    "father_univ_diploma": [0, 1], "other_gender_siblings": [0, 1], "nuclear_family": ["0", "1"],
    "residence": RESIDENCE_LEVELS, "lag_expenses": QUARTILES}


SUBSAMPLES = ["all", "not separated", "1965-1969", "1970-1974", "1975-1984"]


def panel_models(spark, sf) -> DataFrame:
    """45 fits: nine nested specifications on five subsamples."""
    sample = sample_of(spark, sf, SurveyTables(spark, sf))
    cohort = F.col("birth_year_trunc")
    subgroups = dict(zip(SUBSAMPLES, (F.lit(True), F.col("is_separated") == 0, cohort == 1965, cohort == 1970, cohort.between(1975, 1984))))
    return fit_specifications(sample, "univ_diploma", nested_specifications(MODEL_GROUPS, OPTIONAL), MODEL_LEVELS, subgroups,
                              OPTIONAL)


@query("panel_specifications")
def panel_specifications(spark, sf):
    return panel_models(spark, sf)


@query("panel_coefficient_table")
def panel_coefficient_table(spark, sf):
    """Family-size and birth-order estimates of all models, one row per subsample and specification."""
    fitted = checkpointed(panel_models(spark, sf))
    table_ = checkpointed(coefficient_table(fitted, ["kids_num", "kid_order"], list(MODEL_GROUPS)))
    labels = ["+" + s.replace("_", " ") for s in MODEL_GROUPS]
    terms = ["kids_num2", "kids_num3", "kids_num>=4", "kid_order2", "kid_order>=3", "nobs"]
    return stacked({g: transpose(table_.filter(F.col("subgroup") == g), "term", labels, terms, "specification")
                    for g in SUBSAMPLES}, "subgroup")


SHOWN = ["father_univ_diploma", "mother_univ_diploma", "gender", "residence", "birth_year_trunc", "kids_num", "kid_order",
         "nuclear_family", "other_gender_siblings"]


def level_counts(sample: DataFrame) -> DataFrame:
    """(variable, level, n, ones) of every level of the variables shown."""
    rows = F.array(*[F.struct(F.lit(x).alias("variable"), F.col(x).cast("string").alias("level")) for x in SHOWN])
    return sample.select("univ_diploma", F.explode(rows).alias("p")).filter(F.col("p.level").isNotNull()).groupBy(
        F.col("p.variable").alias("variable"), F.col("p.level").alias("level")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("univ_diploma").cast("long").alias("ones"))


def odds_of(sample: DataFrame, extra: list[str]) -> DataFrame:
    """``level_counts`` with odds_ratio, low, high: the odds ratios with profile limits; empty for the first level, the baseline."""
    limits = profile_intervals(sample, "univ_diploma", [*SHOWN, *extra], MODEL_LEVELS)
    # one row per level on either side
    return level_counts(sample).withColumn("term", F.concat("variable", "level")).join(
        limits.select("term", "odds_ratio", "low", "high"), "term", "left").drop("term")


@query("panel_odds_ratios")
def panel_odds_ratios(spark, sf):
    """Odds ratios of the diploma with the size of every level, for all and for those who were never separated."""
    sample = checkpointed(sample_of(spark, sf, SurveyTables(spark, sf)))
    parts = {"all": odds_of(sample, ["is_separated"]), "not separated": odds_of(sample.filter(F.col("is_separated") == 0), [])}
    return stacked(parts, "subgroup")


@query("panel_level_counts", PANEL_SQL + """,
s AS (SELECT *, CASE WHEN is_separated = 0 THEN ['all', 'not separated'] ELSE ['all'] END AS groups FROM sample),
g AS (SELECT *, unnest(groups) AS subgroup FROM s),
l AS (SELECT subgroup, univ_diploma, unnest(['father_univ_diploma', 'mother_univ_diploma', 'gender', 'residence', 'birth_year_trunc', 'kids_num',
        'kid_order', 'nuclear_family', 'other_gender_siblings']) AS variable,
      unnest([CAST(father_univ_diploma AS VARCHAR), CAST(mother_univ_diploma AS VARCHAR), gender, residence, CAST(birth_year_trunc AS VARCHAR),
        kids_num, kid_order, nuclear_family, CAST(other_gender_siblings AS VARCHAR)]) AS level FROM g)
SELECT subgroup, variable, level, count(*) AS n, CAST(sum(univ_diploma) AS BIGINT) AS ones FROM l WHERE level IS NOT NULL GROUP BY ALL""")
def panel_level_counts(spark, sf):
    """The level counts beside the odds ratios of ``panel_odds_ratios``."""
    sample = checkpointed(sample_of(spark, sf, SurveyTables(spark, sf)))
    return stacked({"all": level_counts(sample), "not separated": level_counts(sample.filter(F.col("is_separated") == 0))}, "subgroup")


CURVE_XS = ["kids_num", "kid_order", "gender", "birth_year_trunc", "mother_univ_diploma", "father_univ_diploma", "other_gender_siblings"]
RARE = "SPB"


@query("panel_metric_curve")
def panel_metric_curve(spark, sf):
    """Hold-out metrics on the sample without its rare residence: 51 training proportions x 10 splits, for all and not separated."""
    sample = checkpointed(sample_of(spark, sf, SurveyTables(spark, sf)).filter(F.col("residence") != RARE))
    props = [round(0.25 + 0.01 * i, 2) for i in range(51)]
    return stacked({label: metric_curve(rows, "univ_diploma", CURVE_XS, MODEL_LEVELS, props, 10) for label, rows in (
        ("all", sample), ("not separated", sample.filter(F.col("is_separated") == 0)))}, "type")
