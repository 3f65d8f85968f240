"""Conformed (silver) tables to sales marts (gold).

Facts are aggregated to their join key before they meet a dimension: the shuffle carries one
partial row per key and task, so a territory or product with a third of all rows costs no more
than any other, and the join runs on key-sized data. Averages travel as sum and count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from siltworks.functions.columns import constant, mean, rounded, stamped
from siltworks.operators.skew import lookup

STAMP = "_gold_at"


def gold_sales_by_territory(orders: DataFrame, territories: DataFrame) -> DataFrame:
    """Orders, customers, revenue and freight per territory, highest revenue first."""
    names = ["territory", "country_code", "region_group"]
    facts = orders.groupBy("territory_id").agg(
        F.count("order_id").alias("total_orders"),
        F.countDistinct("customer_id").alias("unique_customers"),
        F.sum("total").alias("total_revenue"),
        F.count("total").alias("_n"),
        F.sum("freight").alias("total_freight"),
    )
    # A territory listed k times with the same names counts every order k times, as in a plain join.
    dimension = territories.groupBy("territory_id", *names).agg(F.count(F.lit(1)).alias("_k"))
    times = F.coalesce("_k", F.lit(1))
    sales = lookup(facts, dimension, "territory_id").select(
        "territory_id",
        *names,
        (F.col("total_orders") * times).alias("total_orders"),
        "unique_customers",
        (F.col("total_revenue") * times).alias("total_revenue"),
        mean(F.col("total_revenue"), F.col("_n")).alias("avg_ticket"),
        (F.col("total_freight") * times).alias("total_freight"),
    )
    sales = stamped(rounded(sales, 2, "total_revenue", "avg_ticket", "total_freight"), STAMP)
    return sales.orderBy(F.desc("total_revenue"))


def _per_product(lines: DataFrame) -> DataFrame:
    """Order lines folded to one row per product."""
    return lines.groupBy("product_id").agg(
        F.count("line_id").alias("_lines"),
        F.sum("quantity").alias("_units"),
        F.sum("line_total").alias("_revenue"),
        F.sum("unit_price").alias("_price"),
        F.count("unit_price").alias("_price_n"),
        F.sum("discount").alias("_discount"),
        F.count("discount").alias("_discount_n"),
    )


def gold_sales_by_category(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Lines, units, revenue, price and discount per category and subcategory, highest revenue first."""
    dimension = products.select("product_id", "category", "subcategory")
    sales = (
        lookup(_per_product(lines), dimension, "product_id")
        .groupBy("category", "subcategory")
        .agg(
            F.sum("_lines").alias("lines_sold"),
            F.sum("_units").alias("units_sold"),
            F.sum("_revenue").alias("total_revenue"),
            mean(F.sum("_price"), F.sum("_price_n")).alias("avg_price"),
            mean(F.sum("_discount"), F.sum("_discount_n")).alias("avg_discount"),
        )
    )
    sales = rounded(rounded(sales, 2, "total_revenue", "avg_price"), 4, "avg_discount")
    return stamped(sales, STAMP).orderBy(F.desc("total_revenue"))


def gold_sales_by_period(orders: DataFrame) -> DataFrame:
    """Orders, customers, revenue and the online share per month, in time order.

    An order with an unknown channel counts as neither online nor store.
    """
    day = F.col("order_date")
    online, store = F.col("online_orders"), F.col("store_orders")
    sales = (
        orders.groupBy(F.year(day).alias("year"), F.quarter(day).alias("quarter"), F.month(day).alias("month"))
        .agg(
            F.count("order_id").alias("total_orders"),
            F.countDistinct("customer_id").alias("unique_customers"),
            F.sum("total").alias("total_revenue"),
            F.avg("total").alias("avg_ticket"),
            F.count_if(F.col("is_online")).alias("online_orders"),
            F.count_if(~F.col("is_online")).alias("store_orders"),
        )
        .withColumn("pct_online", F.round(F.try_divide(online, online + store) * 100, 2))
    )
    return stamped(rounded(sales, 2, "total_revenue", "avg_ticket"), STAMP).orderBy("year", "quarter", "month")


def gold_product_ranking(lines: DataFrame, products: DataFrame, n: int | None = None) -> DataFrame:
    """Every product by revenue; with ``n`` only the best ``n``.

    The margin assumes a cost of 60 % and starts from the rounded revenue and price.
    """
    dimension = products.select("product_id", "product", "category", "subcategory")
    sales = (
        lookup(_per_product(lines), dimension, "product_id")
        .groupBy("product_id", "product", "category", "subcategory")
        .agg(
            F.sum("_lines").alias("times_sold"),
            F.sum("_units").alias("total_units"),
            F.sum("_revenue").alias("total_revenue"),
            mean(F.sum("_price"), F.sum("_price_n")).alias("avg_price"),
        )
    )
    sales = rounded(sales, 2, "total_revenue", "avg_price")
    cost = F.col("total_units") * F.col("avg_price") * constant("0.6", sales.schema["avg_price"].dataType)
    sales = sales.withColumn("est_margin", F.round(F.col("total_revenue") - cost, 2))
    ranked = stamped(sales, STAMP).orderBy(F.desc("total_revenue"), "product_id")
    return ranked if n is None else ranked.limit(n)
