"""General relational coverage over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordered import null_safe, ranked, tile
from ..operators.selection import quantiles
from ..scratch import saver
from ..session import table
from . import query


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def intersect_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").intersect(table(spark, sf_dir, "labels").select("doc_id"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def except_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").subtract(table(spark, sf_dir, "labels").select("doc_id"))


@query("SELECT DISTINCT c_nationkey AS nationkey FROM customer UNION SELECT DISTINCT s_nationkey FROM supplier")
def union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nationkey"))
    return nations.union(table(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""SELECT o_orderstatus, c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey
    GROUP BY GROUPING SETS ((o_orderstatus), (c_mktsegment), ())""")
def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    sets = [[F.col("o_orderstatus")], [F.col("c_mktsegment")], []]
    return joined.groupingSets(sets, "o_orderstatus", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l_returnflag, l_linestatus, round(quantile_cont(l_quantity, 0.5), 4) AS median, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90,
      round(stddev_samp(l_discount), 6) AS sd, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY 1, 2""")
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles by refined histograms: six groups hold all rows, and no task holds a group's values."""
    keys = ["l_returnflag", "l_linestatus"]
    lines = table(spark, sf_dir, "lineitem")
    moments = lines.groupBy(*keys).agg(F.round(F.stddev_samp("l_discount"), 6).alias("sd"), F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"))
    found = quantiles(lines, keys, {"median": ("l_quantity", 0.5), "p90": ("l_extendedprice", 0.9)}, saver(spark, "quantiles"))
    return null_safe(moments, found, keys, "left").select(*keys, F.round("median", 4).alias("median"), F.round("p90", 4).alias("p90"), "sd", "r")


@query()
def approx_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.percentile_approx("l_extendedprice", [0.1, 0.5, 0.9]).alias("deciles"))


@query("""SELECT o_orderkey, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank, CAST(ntile(4) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS INTEGER) AS quartile
    FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderpriority)""")
def rank_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three statuses hold all rows: ranked in ranges with carried counts, not in three tasks."""
    orders, save = table(spark, sf_dir, "orders"), saver(spark, "ranks")
    by_priority = ranked(orders.select("o_orderkey", "o_orderstatus", "o_orderpriority"), ["o_orderstatus"], ["o_orderpriority"], save, "priority")
    by_price = ranked(orders.select("o_orderkey", "o_orderstatus", "o_totalprice"), ["o_orderstatus"], ["o_totalprice", "o_orderkey"], save, "price")
    return by_priority.select("o_orderkey", "rank", "dense_rank").join(by_price.select("o_orderkey", tile(4).alias("quartile")), "o_orderkey")


@query("""SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running,
      first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS first_key FROM orders""")
def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    running = F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(running, 2).alias("running"), F.first("o_orderkey").over(w).alias("first_key"))


@query("SELECT c_mktsegment, c_custkey, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) <= 3")
def top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, sf_dir, "customer").withColumn("r", F.row_number().over(best)).filter("r <= 3").select("c_mktsegment", "c_custkey", "c_acctbal")


@query("""SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1""")
def pivot_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return counts.na.fill(0)


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n_lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY n_name""")
def star_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").filter("l_shipdate >= timestamp_ntz '1995-01-01'").select("l_orderkey", "l_extendedprice", "l_discount")
    # Summed by order first: one row an order meets the other joins.
    per_order = lines.groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), F.count(F.lit(1)).alias("n"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = per_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    joined = joined.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.round(F.sum("revenue"), 2).alias("revenue"), F.sum("n").alias("n_lines"))


@query("""SELECT c_custkey, c_name, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_orders FROM customer""")
def semi_anti_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    on = F.col("c_custkey") == F.col("o_custkey")
    have = customer.join(orders, on, "left_semi").select("c_custkey", "c_name", F.lit(True).alias("has_orders"))
    return have.union(customer.join(orders, on, "left_anti").select("c_custkey", "c_name", F.lit(False)))


@query("""SELECT coalesce(c.k, s.k) AS nationkey, c.n AS n_customers, s.n AS n_suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1) c
    FULL OUTER JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) s ON c.k = s.k""")
def full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").filter("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count(F.lit(1)).alias("n_customers"))
    s = table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count(F.lit(1)).alias("n_suppliers"))
    return c.join(s, "nationkey", "full_outer")


@query("""SELECT o_orderkey, CAST(datediff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS days, CAST(extract(year FROM o_orderdate) AS INTEGER) AS year,
      strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month, upper(left(o_orderpriority, 3)) AS urgency, round(sqrt(o_totalprice), 4) AS root FROM orders""")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.datediff(day, F.lit("1992-01-01").cast("date")).alias("days"), F.year(day).alias("year"), F.date_format(F.trunc(day, "month"), "yyyy-MM-dd").alias("month"),
        F.upper(F.left("o_orderpriority", F.lit(3))).alias("urgency"), F.round(F.sqrt("o_totalprice"), 4).alias("root"),
    )


@query("""SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS keys, count(DISTINCT o_orderstatus) AS n_status FROM orders GROUP BY o_custkey""")
def array_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda k: k.cast("string"))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(keys, ",").alias("keys"), F.count_distinct("o_orderstatus").alias("n_status"))


@query("SELECT p_brand, p_type, round(avg(p_retailprice), 4) AS price FROM part GROUP BY p_brand, p_type HAVING count(*) >= 2")
def having_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.avg("p_retailprice").alias("price"), F.count(F.lit(1)).alias("n"))
    return by.filter("n >= 2").select("p_brand", "p_type", F.round("price", 4).alias("price"))
