"""Sources, scalar expressions, filters and reshaping on the test tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinpanel.functions import arrays as A
from kinpanel.functions import expressions as E
from kinpanel.operators import reshape as R
from kinpanel.plans.registry import query, table
from kinpanel.session import scratch_path
from kinpanel.sources import tables as S


def cents(name: str) -> Column:
    """Money as whole cents: sums then do not depend on the order of addition."""
    return F.round(F.col(name) * 100).cast("long")


# ---------------------------------------------------------------------------------------------- sources


@query("scan_projected", "SELECT l_orderkey AS order_id, l_quantity AS quantity, l_returnflag AS flag FROM lineitem")
def scan_projected(spark, sf):
    scan = S.scan(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_quantity", "l_returnflag"])
    return scan.withColumnsRenamed({"l_orderkey": "order_id", "l_quantity": "quantity", "l_returnflag": "flag"})


@query("range_filters", """
SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1999-01-01'
  AND l_quantity BETWEEN 10 AND 30 AND l_returnflag IN ('A', 'R') AND l_linestatus <> 'F' AND l_discount IS NOT NULL""")
def range_filters(spark, sf):
    keep = (
        (F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp_ntz"))
        & (F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp_ntz"))
        & F.col("l_quantity").between(10, 30) & F.col("l_returnflag").isin("A", "R")
        & (F.col("l_linestatus") != "F") & F.col("l_discount").isNotNull())
    return table(spark, sf, "lineitem").filter(keep).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


@query("dedup_rows", "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def dedup_rows(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct()


@query("scan_directory", """
SELECT o_orderpriority, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS total
FROM orders GROUP BY o_orderpriority""")
def scan_directory(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    folder = S.write_delimited(orders, scratch_path(spark, "delimited"))
    back = S.scan_folder(spark, folder, "o_orderkey long, o_orderpriority string, o_totalprice double")
    return back.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum(cents("o_totalprice")).alias("total"))


@query("sink_roundtrip", """
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n,
       CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS total
FROM orders WHERE year(o_orderdate) >= 1997 GROUP BY 1""")
def sink_roundtrip(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("year"))
    path = S.save(orders, scratch_path(spark, "saved"), ["year"])
    back = S.load(spark, path).filter(F.col("year") >= 1997)
    return back.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.sum(cents("o_totalprice")).alias("total"))


LINE_LABELS = {
    "l_quantity": "number of items", "l_extendedprice": "price of the line", "l_discount": "discount granted",
    "l_tax": "tax rate", "l_shipdate": "day of shipping",
}


@query("columns_by_label", """
SELECT code, count(*) AS n, CAST(sum(c) AS BIGINT) AS total FROM (
  SELECT 'l_extendedprice' AS code, CAST(round(l_extendedprice * 100) AS BIGINT) AS c FROM lineitem
  UNION ALL SELECT 'l_discount', CAST(round(l_discount * 100) AS BIGINT) FROM lineitem)
GROUP BY code""")
def columns_by_label(spark, sf):
    lines = S.with_labels(table(spark, sf, "lineitem"), LINE_LABELS)
    found = S.columns_by_label(S.label_dictionary(lines), "price|discount", lines.columns)
    long = R.to_long(lines, [], found, "code", "v")
    return long.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.sum(cents("v")).alias("total"))


@query("label_dictionary", """
SELECT 'number of items' AS name, 'l_quantity' AS code, count(l_quantity) AS filled FROM lineitem
UNION ALL SELECT 'price of the line', 'l_extendedprice', count(l_extendedprice) FROM lineitem
UNION ALL SELECT 'discount granted', 'l_discount', count(l_discount) FROM lineitem
UNION ALL SELECT 'tax rate', 'l_tax', count(l_tax) FROM lineitem
UNION ALL SELECT 'day of shipping', 'l_shipdate', count(l_shipdate) FROM lineitem
UNION ALL SELECT 'l_orderkey', 'l_orderkey', count(l_orderkey) FROM lineitem
UNION ALL SELECT 'l_returnflag', 'l_returnflag', count(l_returnflag) FROM lineitem""")
def label_dictionary(spark, sf):
    """Store labelled lines and their dictionary, read both back, and say how many values each column holds."""
    lines = S.with_labels(table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", *LINE_LABELS), LINE_LABELS)
    data, dictionary = S.ingest_labelled(lines, scratch_path(spark, "labelled"))
    stored = S.load(spark, data)
    filled = stored.agg(*[F.count(c).alias(c) for c in stored.columns]).unpivot([], stored.columns, "code", "filled")
    return S.load(spark, dictionary).join(filled, "code").select("name", "code", "filled")


FOLDER_LABELS = {"nation": {"n_name": "name of the nation", "n_regionkey": "its region"}, "customer": {"c_mktsegment": "market segment"}}


@query("ingest_folder", """
WITH d AS (SELECT unnest(['n_nationkey', 'n_name', 'n_regionkey']) AS code, 'nation' AS source
           UNION ALL SELECT unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment']), 'customer'),
n AS (SELECT 'nation' AS source, count(*) AS rows FROM nation UNION ALL SELECT 'customer', count(*) FROM customer)
SELECT source, code, CASE code WHEN 'n_name' THEN 'name of the nation' WHEN 'n_regionkey' THEN 'its region'
       WHEN 'c_mktsegment' THEN 'market segment' ELSE code END AS name, rows FROM d JOIN n USING (source)""")
def ingest_folder(spark, sf):
    """Two tables of the folder are stored, each with its dictionary; the second run finds nothing to take."""
    target = scratch_path(spark, "folder")
    S.ingest_folder(spark, sf, target, FOLDER_LABELS)
    manifest = S.ingest_folder(spark, sf, target, FOLDER_LABELS).filter(~F.col("taken")).collect()
    return R.stacked({r["table"]: S.load(spark, r["dictionary"]).crossJoin(  # one row with the count
        S.load(spark, r["data"]).agg(F.count(F.lit(1)).alias("rows"))) for r in manifest}, "source")


# ------------------------------------------------------------------------------------------ expressions


@query("fallback_chain", """
SELECT o_orderkey,
       coalesce(nullif(o_orderstatus, 'F'), nullif(o_orderpriority, '5-LOW'), CAST(o_orderkey % 7 AS VARCHAR)) AS answer,
       CAST(greatest(coalesce(nullif(o_orderkey % 5, 3) - nullif(o_custkey % 4, 2), 0), 0) AS BIGINT) AS elders
FROM orders""")
def fallback_chain(spark, sf):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        E.fallback(F.nullif("o_orderstatus", F.lit("F")), F.nullif("o_orderpriority", F.lit("5-LOW")),
                   (key % 7).cast("string")).alias("answer"),
        E.count_sum(F.nullif(key % 5, F.lit(3)), -F.nullif(cust % 4, F.lit(2))).alias("elders"))


@query("three_valued_flag", """
SELECT l_orderkey, l_linenumber,
       CASE WHEN l_quantity > 40 OR nullif(l_returnflag, 'N') = 'R' THEN 1
            WHEN NOT (l_quantity > 40 OR nullif(l_returnflag, 'N') = 'R') THEN 0 END AS flag
FROM lineitem""")
def three_valued_flag(spark, sf):
    test = E.any_of([F.col("l_quantity") > 40, F.nullif("l_returnflag", F.lit("N")) == "R"])
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", E.three_valued(test).alias("flag"))


@query("ordered_band", """
SELECT o_orderkey,
       CASE WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_totalprice BETWEEN 300000 AND 400000 THEN 'large'
            WHEN o_totalprice >= 450000 THEN 'huge' WHEN o_totalprice >= 100000 THEN 'middle' ELSE 'small' END AS band,
       CASE WHEN year(o_orderdate) BETWEEN 1990 AND 1996 THEN '1990-1996'
            WHEN year(o_orderdate) BETWEEN 1997 AND 1999 THEN '1997-1999' END AS period
FROM orders""")
def ordered_band(spark, sf):
    price, year = F.col("o_totalprice"), F.year("o_orderdate")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        E.choose([(F.col("o_orderstatus") == "P", "pending"), (price.between(300000, 400000), "large"),
                  (price >= 450000, "huge"), (price >= 100000, "middle")], "small").alias("band"),
        E.choose([(year.between(1990, 1996), "1990-1996"), (year.between(1997, 1999), "1997-1999")]).alias("period"))


@query("recode_classes", """
SELECT c_custkey, CASE WHEN c_nationkey % 2 = 1 THEN 'male' ELSE 'female' END AS side,
       CASE WHEN c_acctbal < 0 THEN 'unemployed' WHEN c_acctbal < 5000 AND c_nationkey <> 0 THEN 'qualified'
            ELSE 'not qualified' END AS class,
       CAST(c_nationkey AS VARCHAR) || '_' || c_mktsegment AS family
FROM customer""")
def recode_classes(spark, sf):
    bal, nation = F.col("c_acctbal"), F.col("c_nationkey")
    return table(spark, sf, "customer").select(
        "c_custkey", E.choose([(nation % 2 == 1, "male")], "female").alias("side"),
        E.choose([(bal < 0, "unemployed"), ((bal < 5000) & (nation != 0), "qualified")], "not qualified").alias("class"),
        E.family_key(nation, F.col("c_mktsegment")).alias("family"))


@query("fixed_width_bucket", """
SELECT p_partkey, CAST(floor(p_size / 5) * 5 AS INTEGER) AS by5, CAST(floor(p_size / 10) * 10 AS INTEGER) AS by10
FROM part""")
def fixed_width_bucket(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", E.fixed_bucket(F.col("p_size"), 5).alias("by5"), E.fixed_bucket(F.col("p_size"), 10).alias("by10"))


@query("top_code", """
SELECT p_partkey, CASE WHEN p_size >= 8 THEN '>=8' ELSE CAST(p_size AS VARCHAR) END AS size_class,
       CAST(least(p_size, 8) AS INTEGER) AS place, TRY_CAST(split_part(p_brand, '#', 2) AS INTEGER) AS brand
FROM part""")
def top_code(spark, sf):
    label = E.top_code(F.col("p_size"), 8)
    return table(spark, sf, "part").select(
        "p_partkey", label.alias("size_class"), E.level_index(label, E.top_code_levels(8)).alias("place"),
        F.split_part("p_brand", F.lit("#"), F.lit(2)).try_cast("int").alias("brand"))


@query("parse_slot_codes", """
SELECT conv_id, turn, CAST(turn AS VARCHAR) AS kid, CAST(turn + 1 AS VARCHAR) AS parent,
       CAST(turn AS VARCHAR) AS gender_slot, CAST(turn AS VARCHAR) AS member
FROM conversations""")
def parse_slot_codes(spark, sf):
    t = F.col("turn").cast("string")
    after = (F.col("turn") + 1).cast("string")
    # both spellings of a grid name occur
    grid = F.concat(F.lit("b"), t, F.when(F.col("turn") % 2 == 0, ".9.").otherwise(".9"), after)
    kid, parent = E.relation_slots(grid)
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", kid.alias("kid"), parent.alias("parent"),
        E.gender_slot(F.concat(F.lit("b"), t, F.lit(".5"))).alias("gender_slot"),
        E.member_slot(F.concat(F.lit("idind"), t)).alias("member"))


@query("array_predicates", """
WITH lists AS (SELECT l_orderkey, list(DISTINCT l_linenumber ORDER BY l_linenumber)
                      FILTER (WHERE l_returnflag <> 'N') AS items
               FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, CAST(coalesce(list_contains(items, 4), false) AS INTEGER) AS has_four,
       CAST(coalesce(list_has_any(items, [1, 2]), false) AS INTEGER) AS has_low,
       CAST(coalesce(len(list_filter(items, lambda x: x % 7 = 6)), 0) AS INTEGER) AS sixes,
       CAST(coalesce(len(items), 0) AS INTEGER) AS size,
       CASE WHEN len(items) = 1 THEN items[1] END AS single
FROM lists""")
def array_predicates(spark, sf):
    """Lists of distinct line numbers (at most seven) of the returned lines; an order without any has no list."""
    returned = F.when(F.col("l_returnflag") != "N", F.col("l_linenumber"))
    lists = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(returned)).alias("items"))
    items = F.when(F.size("items") > 0, F.col("items"))
    return lists.select(
        "l_orderkey", A.has_value(items, 4).cast("int").alias("has_four"), A.has_any(items, [1, 2]).cast("int").alias("has_low"),
        A.count_value(F.transform(items, lambda x: x % 7), 6).alias("sixes"), A.length(items).alias("size"),
        A.only_value(items).alias("single"))


@query("share_labels", """
WITH c AS (SELECT l_linestatus, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2),
     s AS (SELECT *, n / sum(n) OVER (PARTITION BY l_linestatus) AS share FROM c)
SELECT l_linestatus, l_returnflag,
       format('{:,}', n) || ' (' || regexp_replace(CAST(round(share * 100, 1) AS VARCHAR), '\\.0$', '') || '%)' AS label
FROM s""")
def share_labels(spark, sf):
    from kinpanel.operators.aggregates import class_shares

    shares = class_shares(table(spark, sf, "lineitem"), ["l_linestatus"], ["l_returnflag"])
    return shares.select("l_linestatus", "l_returnflag", E.share_label(F.col("n"), F.col("share")).alias("label"))


# -------------------------------------------------------------------------------------------- reshaping


@query("unpivot_roster", """
SELECT l_orderkey, l_linenumber, name, value FROM (
  SELECT l_orderkey, l_linenumber, 'l_quantity' AS name, l_quantity AS value FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, 'discount', nullif(l_discount, 0) FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, 'tax', nullif(l_tax, 0) FROM lineitem)
WHERE value IS NOT NULL""")
def unpivot_roster(spark, sf):
    wide = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", F.nullif("l_discount", F.lit(0.0)).alias("discount"),
        F.nullif("l_tax", F.lit(0.0)).alias("tax"))
    return R.to_long(wide, ["l_orderkey", "l_linenumber"], ["l_quantity", "discount", "tax", "not_there"])


@query("pivot_lists", """
SELECT l_orderkey,
       coalesce(string_agg(DISTINCT CASE WHEN l_returnflag = 'A' THEN CAST(l_linenumber AS VARCHAR) END, ','
                           ORDER BY CASE WHEN l_returnflag = 'A' THEN CAST(l_linenumber AS VARCHAR) END), '') AS a,
       coalesce(string_agg(DISTINCT CASE WHEN l_returnflag = 'N' THEN CAST(l_linenumber AS VARCHAR) END, ','
                           ORDER BY CASE WHEN l_returnflag = 'N' THEN CAST(l_linenumber AS VARCHAR) END), '') AS n,
       coalesce(string_agg(DISTINCT CASE WHEN l_returnflag = 'R' THEN CAST(l_linenumber AS VARCHAR) END, ','
                           ORDER BY CASE WHEN l_returnflag = 'R' THEN CAST(l_linenumber AS VARCHAR) END), '') AS r
FROM lineitem GROUP BY l_orderkey""")
def pivot_lists(spark, sf):
    wide = R.to_wide_lists(table(spark, sf, "lineitem"), ["l_orderkey"], "l_returnflag", ["A", "N", "R"], "l_linenumber")
    return wide.select("l_orderkey", *[A.joined(F.col(c)).alias(c.lower()) for c in ("A", "N", "R")])


_STATUS_SHARES = """
WITH c AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2),
     s AS (SELECT *, round(n / sum(n) OVER (PARTITION BY year), 6) AS share FROM c)
"""


def status_shares(spark, sf):
    from kinpanel.operators.aggregates import class_shares

    orders = table(spark, sf, "orders").select(F.year("o_orderdate").alias("year"), "o_orderstatus")
    shares = class_shares(orders, ["year"], ["o_orderstatus"]).withColumn("share", F.round("share", 6))
    return R.to_wide(shares, ["year"], "o_orderstatus", ["F", "O", "P"], F.first("share"))


@query("pivot_shares", _STATUS_SHARES + """
SELECT year, max(share) FILTER (WHERE o_orderstatus = 'F') AS "F", max(share) FILTER (WHERE o_orderstatus = 'O') AS "O",
       max(share) FILTER (WHERE o_orderstatus = 'P') AS "P" FROM s GROUP BY year""")
def pivot_shares(spark, sf):
    return status_shares(spark, sf)


@query("transpose_table", _STATUS_SHARES + """
SELECT o_orderstatus AS term, """ + ", ".join(
    f'max(share) FILTER (WHERE year = {y}) AS "{y}"' for y in range(1995, 2002)) + """
FROM s GROUP BY o_orderstatus""")
def transpose_table(spark, sf):
    return R.transpose(status_shares(spark, sf), "year", ["F", "O", "P"], list(range(1995, 2002)))


@query("union_labelled", """
SELECT sample, year, count(*) AS n FROM (
  SELECT 'all' AS sample, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders
  UNION ALL SELECT 'urgent', CAST(year(o_orderdate) AS INTEGER) FROM orders WHERE o_orderpriority = '1-URGENT')
GROUP BY 1, 2""")
def union_labelled(spark, sf):
    orders = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    parts = {"all": orders, "urgent": orders.filter(F.col("o_orderpriority") == "1-URGENT")}
    return R.stacked({k: d.groupBy("year").agg(F.count(F.lit(1)).alias("n")) for k, d in parts.items()}, "sample")
