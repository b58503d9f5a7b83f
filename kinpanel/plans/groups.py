"""Aggregates, joins and ranking operators on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinpanel.functions import arrays as A
from kinpanel.functions import expressions as E
from kinpanel.operators import aggregates as G
from kinpanel.operators import household as H
from kinpanel.operators import joins as J
from kinpanel.operators.scale import join_counted, keep_at_extreme, salted_join
from kinpanel.plans.registry import query, table


def dated_orders(spark, sf):
    return table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))


# --------------------------------------------------------------------------------------------- aggregates


@query("entity_min", """
SELECT o_orderkey, CAST(min(coalesce(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE year(o_orderdate) END, year(o_orderdate)))
                        OVER (PARTITION BY o_custkey) AS INTEGER) AS first_year,
       CAST(CASE WHEN count(*) FILTER (WHERE o_orderkey % 9 = 0) OVER (PARTITION BY o_custkey) = 0
                 THEN min(o_orderkey) OVER (PARTITION BY o_custkey) END AS BIGINT) AS strict_min
FROM orders""")
def entity_min(spark, sf):
    orders = dated_orders(spark, sf).select(
        "o_orderkey", "o_custkey",
        E.fallback(F.when(F.col("o_orderkey") % 3 != 0, F.col("year")), F.col("year")).alias("reported"),
        F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderkey")).alias("answer"))
    both = G.entity_minima(orders, ["o_custkey"], {"first_year": ("reported", False), "strict_min": ("answer", True)})
    return both.select("o_orderkey", "first_year", "strict_min")


@query("ever_flag", """
SELECT o_orderkey, max(CASE WHEN o_totalprice > 490000 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey) AS ever
FROM orders""")
def ever_flag(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey",
                                               E.three_valued(F.col("o_totalprice") > 490000).alias("flag"))
    return G.ever_flag(orders, ["o_custkey"], "flag", "ever").select("o_orderkey", "ever")


@query("carry_forward_flag", """
SELECT o_orderkey, max(CASE WHEN o_totalprice > 490000 THEN 1 ELSE 0 END)
       OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried
FROM orders""")
def carry_forward_flag(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate",
                                               E.three_valued(F.col("o_totalprice") > 490000).alias("flag"))
    return G.carry_forward_flag(orders, ["o_custkey"], "o_orderdate", "flag", "carried").select("o_orderkey", "carried")


@query("quantile_band", """
WITH o AS (SELECT o_orderkey, year(o_orderdate) AS year,
                  CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_totalprice END AS price FROM orders),
     q AS (SELECT year, quantile_cont(price, 0.25) AS a, quantile_cont(price, 0.5) AS b, quantile_cont(price, 0.75) AS c
           FROM o GROUP BY year)
SELECT o_orderkey, CASE WHEN price <= a THEN 'I Q' WHEN price <= b THEN 'II Q' WHEN price <= c THEN 'III Q'
                        WHEN price IS NOT NULL THEN 'IV Q' END AS band
FROM o JOIN q USING (year)""")
def quantile_band(spark, sf):
    orders = dated_orders(spark, sf).select(
        "o_orderkey", "year", F.when(F.col("o_orderkey") % 50 != 0, F.col("o_totalprice")).alias("price"))
    return G.quantile_band(orders, ["year"], "price", "band", ["I Q", "II Q", "III Q", "IV Q"]).select("o_orderkey", "band")


@query("grouped_lists", """
WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber AS slot, l_returnflag AS code FROM lineitem)
SELECT l_orderkey, string_agg(CAST(slot AS VARCHAR), ',' ORDER BY slot, code) AS slots,
       string_agg(code, ',' ORDER BY slot, code) AS codes
FROM d GROUP BY l_orderkey""")
def grouped_lists(spark, sf):
    lists = G.aligned_lists(table(spark, sf, "lineitem"), ["l_orderkey"], slot="l_linenumber", code="l_returnflag")
    return lists.select("l_orderkey", A.joined(F.col("slot")).alias("slots"), A.joined(F.col("code")).alias("codes"))


@query("unambiguous_pairs", """
WITH d AS (SELECT o_custkey, year(o_orderdate) AS year, count(DISTINCT o_orderstatus) AS kinds FROM orders GROUP BY 1, 2)
SELECT o_orderkey, o.o_custkey, o_orderstatus, kinds FROM orders o
JOIN d ON d.o_custkey = o.o_custkey AND d.year = year(o_orderdate) WHERE kinds = 1""")
def unambiguous_pairs(spark, sf):
    orders = dated_orders(spark, sf).select("o_orderkey", "o_custkey", "o_orderstatus", "year")
    return G.unambiguous(orders, ["o_custkey", "year"], "o_orderstatus", "kinds").select("o_orderkey", "o_custkey", "o_orderstatus", "kinds")


@query("share_within_group", """
WITH c AS (SELECT c_mktsegment, o_orderstatus, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT *, round(n / sum(n) OVER (PARTITION BY c_mktsegment), 6) AS share FROM c""")
def share_within_group(spark, sf):
    # a customer's orders are counted by status before the join, so a hot customer is a few rows there
    orders = table(spark, sf, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("orders"))
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    shares = G.class_shares(orders.join(customers, "o_custkey"), ["c_mktsegment"], ["o_orderstatus"], weight="orders")
    return shares.withColumn("share", F.round("share", 6)).orderBy("c_mktsegment", "o_orderstatus")


@query("distinct_share", """
WITH c AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderstatus, count(DISTINCT o_custkey) AS people
           FROM orders GROUP BY 1, 2)
SELECT *, round(people / sum(people) OVER (PARTITION BY year), 6) AS share FROM c""")
def distinct_share(spark, sf):
    shares = G.class_shares(dated_orders(spark, sf), ["year"], ["o_orderstatus"], "o_custkey", "people")
    return shares.withColumn("share", F.round("share", 6))


@query("group_rate", """
SELECT CAST(year(o_orderdate) AS INTEGER) AS year,
       round(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) / count(*), 6) AS rate
FROM orders GROUP BY 1""")
def group_rate(spark, sf):
    rates = G.group_rate(dated_orders(spark, sf), ["year"], F.col("o_orderstatus") == "F")
    return rates.withColumn("rate", F.round("rate", 6))


@query("count_of_counts", """
SELECT size, count(*) AS groups FROM (SELECT o_custkey, count(*) AS size FROM orders GROUP BY 1) GROUP BY size""")
def count_of_counts(spark, sf):
    return G.count_of_counts(table(spark, sf, "orders"), ["o_custkey"])


@query("reconcile_size", """
WITH g AS (SELECT l_orderkey, count(DISTINCT l_partkey) AS seen, max(l_linenumber) AS last FROM lineitem GROUP BY 1)
SELECT l.l_orderkey, l_linenumber, CAST(greatest(floor(l_quantity / 10) + 1, seen, last) AS INTEGER) AS size
FROM lineitem l JOIN g USING (l_orderkey)""")
def reconcile_size(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    listed = F.floor(F.col("l_quantity") / 10) + 1
    return G.reconciled_size(lines, ["l_orderkey"], "l_partkey", "l_linenumber", listed, "size").select(
        "l_orderkey", "l_linenumber", "size")


@query("has_other_class", """
SELECT l_orderkey, l_linenumber, l_linestatus,
       CASE WHEN min(l_linestatus) OVER w <> max(l_linestatus) OVER w THEN 1 ELSE 0 END AS other
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)""")
def has_other_class(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus")
    return G.has_other_class(lines, ["l_orderkey"], "l_linestatus", "other")


# -------------------------------------------------------------------------------------------------- joins


@query("dimension_join", """
SELECT o_orderkey, c_mktsegment, n_name FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey""")
def dimension_join(spark, sf):
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    customers = join_counted(table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"),
                             nations, ["c_nationkey"]).withColumnRenamed("c_custkey", "o_custkey")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return salted_join(orders, customers, ["o_custkey"]).select("o_orderkey", "c_mktsegment", "n_name")


@query("longest_list_join", """
WITH d AS (SELECT DISTINCT o_orderkey, o_custkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
     l AS (SELECT o_custkey, o_orderkey, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) AS items,
                  count(*) AS n FROM d GROUP BY 1, 2),
     u AS (SELECT DISTINCT o_custkey, items, n FROM l),
     b AS (SELECT * FROM u QUALIFY n = max(n) OVER (PARTITION BY o_custkey))
SELECT o.o_orderkey, o.o_custkey, b.items FROM orders o LEFT JOIN b ON b.o_custkey = o.o_custkey""")
def longest_list_join(spark, sf):
    """Every order with its customer's longest list of line numbers, all lists of that length kept."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    lists = G.aligned_lists(table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), ["o_orderkey"],
                            items="l_linenumber")
    with_lists = orders.join(lists, "o_orderkey", "left")
    return G.with_longest_list(with_lists, orders, ["o_custkey"], "items").withColumn("items", A.joined(F.col("items")))


@query("exclusion_anti_join", """
SELECT o_orderkey, o_custkey FROM orders
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def exclusion_anti_join(spark, sf):
    debtors = table(spark, sf, "customer").filter(F.col("c_acctbal") < 0).select("c_custkey")
    return J.excluding(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", debtors)


_PURCHASES = """
WITH p AS (SELECT event_id, user_id, date_trunc('hour', ts) AS t FROM events WHERE event_type = 'purchase'),
     v AS (SELECT user_id, date_trunc('hour', ts) AS vt, event_id AS view_id, value FROM events WHERE event_type = 'view'),
     m AS (SELECT p.*, v.view_id, v.value, rank() OVER (PARTITION BY p.event_id ORDER BY v.vt DESC) AS r
           FROM p JOIN v ON v.user_id = p.user_id AND v.vt <= p.t)
"""


def purchases_and_views(spark, sf):
    events = table(spark, sf, "events").withColumn("t", F.date_trunc("hour", "ts"))
    left = events.filter(F.col("event_type") == "purchase").select("event_id", "user_id", "t")
    right = events.filter(F.col("event_type") == "view").select(
        "user_id", F.col("t").alias("view_time"), F.col("event_id").alias("view_id"), "value")
    return left, right


@query("asof_inner", _PURCHASES + "SELECT event_id, view_id, value FROM m WHERE r = 1")
def asof_inner(spark, sf):
    left, right = purchases_and_views(spark, sf)
    return J.asof_join(left, right, ["user_id"], "t", "view_time").select("event_id", "view_id", "value")


@query("asof_left", _PURCHASES + """
SELECT p.event_id, b.view_id, b.value FROM p LEFT JOIN (SELECT * FROM m WHERE r = 1) b ON b.event_id = p.event_id""")
def asof_left(spark, sf):
    left, right = purchases_and_views(spark, sf)
    return J.asof_join(left, right, ["user_id"], "t", "view_time", "left").select("event_id", "view_id", "value")


@query("lagged_attribute", """
WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice, year(o_orderdate) - 1980 AS age FROM orders),
     y AS (SELECT o_custkey, o_orderdate AS d, o_totalprice AS lagged FROM o WHERE age <= 18),
     m AS (SELECT o.o_orderkey, y.lagged, rank() OVER (PARTITION BY o.o_orderkey ORDER BY y.d DESC) AS r
           FROM o JOIN y ON y.o_custkey = o.o_custkey AND y.d <= o.o_orderdate)
SELECT o.o_orderkey, m.lagged FROM o LEFT JOIN m ON m.o_orderkey = o.o_orderkey AND m.r = 1""")
def lagged_attribute(spark, sf):
    orders = dated_orders(spark, sf).select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice",
                                            (F.col("year") - 1980).alias("age"))
    return H.lagged_attribute(orders, "o_custkey", "o_orderdate", "age", 18, "o_totalprice", "lagged").select(
        "o_orderkey", "lagged")


@query("separation_flag", """
WITH s AS (SELECT DISTINCT user_id AS id, CAST(ts AS DATE) AS day,
                  (user_id + length(event_type)) % 3 AS hh FROM events WHERE event_type <> 'error'),
     u AS (SELECT user_id, max(CAST(ts AS DATE)) AS until FROM events WHERE event_type = 'error' GROUP BY 1),
     x AS (SELECT DISTINCT u.user_id FROM u
           JOIN s k ON k.id = u.user_id AND k.day <= u.until
           JOIN s f ON f.id = u.user_id + 1 AND f.day = k.day AND f.hh <> k.hh
           JOIN s m ON m.id = u.user_id + 2 AND m.day = k.day AND m.hh <> k.hh)
SELECT e.event_id, e.user_id, CASE WHEN x.user_id IS NULL THEN 0 ELSE 1 END AS is_separated
FROM events e LEFT JOIN x ON x.user_id = e.user_id WHERE e.event_type = 'error'""")
def separation_flag(spark, sf):
    events = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    errors = events.filter(F.col("event_type") == "error").select(
        "event_id", "user_id", "day", (F.col("user_id") + 1).alias("father"), (F.col("user_id") + 2).alias("mother"))
    seen = events.filter(F.col("event_type") != "error").select(
        F.col("user_id").alias("id"), F.col("day").alias("wave"),
        ((F.col("user_id") + F.length("event_type")) % 3).alias("hh"))
    apart = J.apart_together(errors, seen, "user_id", ["father", "mother"], "day", "id", "wave", "hh")
    return J.membership(errors, "user_id", apart, "is_separated").select("event_id", "user_id", "is_separated")


# ------------------------------------------------------------------------------------------------ ranking


@query("first_qualifying", """
SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE year(o_orderdate) >= 1996
QUALIFY rank() OVER (PARTITION BY o_custkey ORDER BY year(o_orderdate)) = 1""")
def first_qualifying(spark, sf):
    orders = dated_orders(spark, sf).filter(F.col("year") >= 1996).select("o_orderkey", "o_custkey", "o_orderstatus", "year")
    return keep_at_extreme(orders, ["o_custkey"], "year", "min").drop("year")


@query("sibling_order", """
WITH f AS (SELECT o_custkey, min(year(o_orderdate)) AS born FROM orders GROUP BY 1)
SELECT c_custkey, CAST(dense_rank() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY born) AS INTEGER) AS place
FROM customer JOIN f ON o_custkey = c_custkey""")
def sibling_order(spark, sf):
    first = dated_orders(spark, sf).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("year").alias("born"))
    people = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment").join(first, "c_custkey")
    return H.sibling_order(people, ["c_nationkey", "c_mktsegment"], "born", "place").select("c_custkey", "place")


@query("twins_siblings", """
WITH t AS (SELECT DISTINCT o_custkey FROM (SELECT o_custkey, o_orderdate, count(*) AS n FROM orders GROUP BY 1, 2) WHERE n > 1)
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM t)""")
def twins_siblings(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return H.twins_among_siblings(orders, ["o_custkey"], "o_orderdate").select("o_orderkey", "o_custkey")


@query("twin_households", """
WITH p AS (SELECT o_custkey AS hh, o_orderkey AS id, year(o_orderdate) AS born, 2021 - year(o_orderdate) AS age FROM orders),
     pot AS (SELECT hh FROM p GROUP BY hh HAVING count(DISTINCT born) < count(DISTINCT id)),
     b AS (SELECT hh, born, count(*) AS n FROM p WHERE hh IN (SELECT hh FROM pot) GROUP BY 1, 2),
     last AS (SELECT hh, born AS twin_year FROM b QUALIFY born = max(born) OVER (PARTITION BY hh) AND n = 2)
SELECT p.id, p.hh, CAST(p.born AS INTEGER) AS born, CAST(twin_year AS INTEGER) AS twin_year
FROM p JOIN b ON b.hh = p.hh AND b.born = p.born AND b.n = 1 JOIN last ON last.hh = p.hh
WHERE p.born < twin_year AND twin_year - p.born BETWEEN 0 AND 4 AND p.born >= 1970 AND p.age BETWEEN 21 AND 26""")
def twin_households(spark, sf):
    people = dated_orders(spark, sf).select(F.col("o_custkey").alias("hh"), F.col("o_orderkey").alias("id"),
                                            F.col("year").alias("born"), (2021 - F.col("year")).alias("age"))
    return H.twin_last_births(people, "hh", "id", "born", "age", 4, 1970, (21, 26)).drop("age")


# -------------------------------------------------------------------------------------- representativeness


ORDER_CLASSES = {"failed": ("o_orderstatus", "F"), "pending": ("o_orderstatus", "P"), "even": ("parity", 0)}
PERIODS = {"1994-1996": (1990, 1996), "1997-1999": (1997, 1999), "2000-2004": (2000, 2004)}
_DEVIATION = """
WITH o AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_custkey, o_orderstatus, o_orderkey % 2 AS parity,
                  o_orderpriority = '1-URGENT' AS urgent FROM orders),
     l AS (SELECT DISTINCT year, o_custkey, urgent, 'failed' AS name, o_orderstatus AS level, o_orderstatus = 'F' AS hit FROM o
           UNION ALL SELECT DISTINCT year, o_custkey, urgent, 'pending', o_orderstatus, o_orderstatus = 'P' FROM o
           UNION ALL SELECT DISTINCT year, o_custkey, urgent, 'even', CAST(parity AS VARCHAR), parity = 0 FROM o),
     pop AS (SELECT year, name, avg(CAST(hit AS INTEGER)) AS share
             FROM (SELECT DISTINCT year, o_custkey, name, level, hit FROM l) GROUP BY 1, 2),
     sam AS (SELECT year, name, avg(CAST(hit AS INTEGER)) AS share FROM l WHERE urgent GROUP BY 1, 2),
     d AS (SELECT year, name, coalesce(sam.share, 0) - pop.share AS value FROM pop LEFT JOIN sam USING (year, name))
"""


def order_deviation(spark, sf):
    orders = dated_orders(spark, sf).withColumn("parity", F.col("o_orderkey") % 2)
    urgent = orders.filter(F.col("o_orderpriority") == "1-URGENT")
    return H.deviations(urgent, orders, "year", "o_custkey", "o_custkey", ORDER_CLASSES)


def period_of(year):
    return E.choose([(year.between(a, b), label) for label, (a, b) in PERIODS.items()])


@query("sample_deviation", _DEVIATION + "SELECT year, name, round(value, 6) AS value FROM d")
def sample_deviation(spark, sf):
    return order_deviation(spark, sf).withColumn("value", F.round("value", 6))


@query("deviation_by_period", _DEVIATION + """
SELECT CASE WHEN year BETWEEN 1990 AND 1996 THEN '1994-1996' WHEN year BETWEEN 1997 AND 1999 THEN '1997-1999'
            WHEN year BETWEEN 2000 AND 2004 THEN '2000-2004' END AS period, name, round(avg(value), 6) AS avg_deviation
FROM d GROUP BY 1, 2""")
def deviation_by_period(spark, sf):
    by_year = order_deviation(spark, sf).withColumn("period", period_of(F.col("year")))
    return by_year.groupBy("period", "name").agg(F.round(F.avg("value"), 6).alias("avg_deviation"))
