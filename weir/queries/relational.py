"""Scans, aggregates, joins and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.catalog import query, table
from weir.operators.intervals import interval_join


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base,
round(sum(l_extendedprice * (1 - l_discount)), 4) AS sum_disc, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").filter("l_shipdate <= timestamp_ntz'1998-09-02 00:00:00'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 4).alias("sum_disc"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count("*").alias("n"))


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_extendedprice * l_discount, 4) AS saved FROM lineitem
WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24 AND l_returnflag <> 'N'""")
def filter_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").filter("l_discount BETWEEN 0.05D AND 0.07D AND l_quantity < 24 AND l_returnflag <> 'N'")
    return li.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round(F.expr("l_extendedprice * l_discount"), 4).alias("saved"))


@query("SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25")
def top_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(25)


@query("SELECT DISTINCT p_brand, p_size FROM part")
def distinct_brand_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_brand", "p_size").distinct()


@query("""SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished,
round(median(o_totalprice), 4) AS median_price, min(o_orderdate) AS first_day, max(o_orderdate) AS last_day FROM orders GROUP BY 1""")
def distinct_and_filtered_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    aggs = [F.countDistinct("o_custkey").alias("customers"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.round(F.median("o_totalprice"), 4).alias("median_price"), F.min("o_orderdate").alias("first_day"), F.max("o_orderdate").alias("last_day")]
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(*aggs)


@query("""SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS spent FROM orders GROUP BY 1 HAVING count(*) >= 12""")
def having(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("spent")).filter("n >= 12")


_GROUPED = "o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus) AS INT) AS g_status, CAST(grouping(o_orderpriority) AS INT) AS g_priority, count(*) AS n, round(sum(o_totalprice), 2) AS total"


def _grouped(kind: str):
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        orders = table(spark, sf_dir, "orders")
        by = {"rollup": lambda: orders.rollup("o_orderstatus", "o_orderpriority"), "cube": lambda: orders.cube("o_orderstatus", "o_orderpriority"), "sets": lambda: orders.groupingSets([["o_orderstatus"], ["o_orderpriority"]], "o_orderstatus", "o_orderpriority")}[kind]()
        return by.agg(F.grouping("o_orderstatus").cast("int").alias("g_status"), F.grouping("o_orderpriority").cast("int").alias("g_priority"), F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))

    return f


@query(f"SELECT {_GROUPED} FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grouped("rollup")(spark, sf_dir)


@query(f"SELECT {_GROUPED} FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grouped("cube")(spark, sf_dir)


@query(f"SELECT {_GROUPED} FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority))")
def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grouped("sets")(spark, sf_dir)


@query("""SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished, count(*) FILTER (WHERE o_orderstatus = 'O') AS open,
count(*) FILTER (WHERE o_orderstatus = 'P') AS pending FROM orders GROUP BY 1""")
def pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count()
    return wide.select("o_orderpriority", *(F.coalesce(c, F.lit(0)).alias(name) for c, name in (("F", "finished"), ("O", "open"), ("P", "pending"))))


@query("""SELECT p_partkey, 'size' AS field, CAST(p_size AS DOUBLE) AS amount FROM part UNION ALL
SELECT p_partkey, 'price' AS field, p_retailprice AS amount FROM part""")
def unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return parts.unpivot("p_partkey", ["size", "price"], "field", "amount")


@query("""SELECT n_name, r_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, count(*) AS n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1, 2""")
def star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").filter("o_orderdate >= timestamp_ntz'1996-01-01 00:00:00' AND o_orderdate < timestamp_ntz'1998-01-01 00:00:00'")
    joined = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    joined = joined.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("n_name", "r_name").agg(F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 4).alias("revenue"), F.count("*").alias("n"))


@query("""SELECT c_custkey, count(o_orderkey) AS n, max(o_orderdate) AS last_day FROM customer LEFT JOIN orders
ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY 1""")
def left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    return table(spark, sf_dir, "customer").join(done, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"), F.max("o_orderdate").alias("last_day"))


@query("""SELECT s_class, suppliers, c_class, customers FROM (SELECT CAST(floor(s_acctbal) AS BIGINT) AS s_class, count(*) AS suppliers FROM supplier GROUP BY 1) FULL JOIN
(SELECT CAST(floor(c_acctbal) AS BIGINT) AS c_class, count(*) AS customers FROM customer GROUP BY 1) ON s_class = c_class""")
def full_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and customers by whole units of their balance; either side has classes that the other lacks."""
    s = table(spark, sf_dir, "supplier").groupBy(F.floor("s_acctbal").alias("s_class")).agg(F.count("*").alias("suppliers"))
    c = table(spark, sf_dir, "customer").groupBy(F.floor("c_acctbal").alias("c_class")).agg(F.count("*").alias("customers"))
    return s.join(c, F.col("s_class") == F.col("c_class"), "full").select("s_class", "suppliers", "c_class", "customers")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = table(spark, sf_dir, "lineitem").filter("l_quantity > 49")
    return table(spark, sf_dir, "orders").join(large, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", "o_custkey")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE nullif(c_nationkey, 5) NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)")
def not_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null-aware: a null on the left is in no result, and a null on the right would leave none."""
    text = "SELECT c_custkey, c_nationkey FROM {c} WHERE nullif(c_nationkey, 5) NOT IN (SELECT s_nationkey FROM {s} WHERE s_acctbal > 9000)"
    return spark.sql(text, c=table(spark, sf_dir, "customer"), s=table(spark, sf_dir, "supplier"))


@query("""SELECT p_partkey, n_nationkey FROM part JOIN nation ON p_retailprice >= 900 + n_nationkey * 50 AND p_retailprice < 900 + n_nationkey * 50 + CASE WHEN n_nationkey = 7 THEN 700 ELSE 100 END""")
def band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join without an equality: prices in overlapping bands of different widths."""
    low = F.col("n_nationkey") * 50.0 + 900
    bands = table(spark, sf_dir, "nation").select("n_nationkey", low.alias("low"), (low + F.when(F.col("n_nationkey") == 7, 700.0).otherwise(100.0)).alias("high"))
    return interval_join(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), bands, [], "p_retailprice", "low", "high", 100).select("p_partkey", "n_nationkey")


@query("""SELECT a.s_suppkey AS a_key, b.s_suppkey AS b_key, a.s_nationkey AS nation FROM supplier a JOIN supplier b
ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey AND abs(a.s_acctbal - b.s_acctbal) < 1000""")
def theta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    a, b = s.alias("a"), s.alias("b")
    close = (F.col("a.s_nationkey") == F.col("b.s_nationkey")) & (F.col("a.s_suppkey") < F.col("b.s_suppkey")) & (F.abs(F.col("a.s_acctbal") - F.col("b.s_acctbal")) < 1000)
    return a.join(b, close).select(F.col("a.s_suppkey").alias("a_key"), F.col("b.s_suppkey").alias("b_key"), F.col("a.s_nationkey").alias("nation"))


@query("""SELECT l_orderkey, l_linenumber, l_quantity, p_partkey FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE l_quantity < (SELECT 0.4 * avg(l_quantity) FROM lineitem i WHERE i.l_partkey = p_partkey) AND p_size > 40""")
def correlated_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    least = li.groupBy(F.col("l_partkey").alias("p_key")).agg((F.avg("l_quantity") * 0.4).alias("least"))
    parts = table(spark, sf_dir, "part").filter("p_size > 40").select("p_partkey")
    return li.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(least, F.col("p_partkey") == F.col("p_key")).filter("l_quantity < least").select("l_orderkey", "l_linenumber", "l_quantity", "p_partkey")


_SET = "SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 9000 {} SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000"


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("nation")), table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("nation"))


@query(_SET.format("UNION ALL"))
def union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sides(spark, sf_dir)
    return a.unionByName(b)


@query(_SET.format("INTERSECT"))
def intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sides(spark, sf_dir)
    return a.intersect(b)


@query(_SET.format("EXCEPT ALL"))
def except_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sides(spark, sf_dir)
    return a.exceptAll(b)
