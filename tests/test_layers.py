from datetime import datetime
from decimal import Decimal
from functools import reduce

from pyspark.sql import functions as F

from siltworks.operators import clean, marts

ORDERS = "order_id int, order_date timestamp, is_online boolean, customer_id int, territory_id int, total decimal(12,2), freight decimal(12,2)"
TERRITORIES = "territory_id int, territory string, country_code string, region_group string"
LINES = "line_id int, product_id int, quantity int, line_total decimal(12,2), unit_price decimal(12,2), discount decimal(4,2)"
PRODUCTS = "product_id int, product string, category string, subcategory string"
DAY = datetime(2024, 5, 17)


def orders(spark, *rows):
    return spark.createDataFrame([(i, DAY, o, c, t, Decimal(x), Decimal("1.00")) for i, o, c, t, x in rows], ORDERS)


def test_orders_are_renamed_rounded_and_stamped(spark):
    header = spark.createDataFrame(
        [(1, DAY, DAY, None, 5, True, 7, None, None, Decimal("1.005"), Decimal("2.004"), Decimal("0.995"), Decimal("9.999"))],
        "SalesOrderID int, OrderDate timestamp, DueDate timestamp, ShipDate timestamp, Status int, OnlineOrderFlag boolean,"
        " CustomerID int, SalesPersonID int, TerritoryID int, SubTotal decimal(12,4), TaxAmt decimal(12,4),"
        " Freight decimal(12,4), TotalDue decimal(12,4)",
    )
    row = clean.silver_orders(header).first().asDict()
    assert [row[c] for c in ("subtotal", "tax", "freight", "total")] == [Decimal(x) for x in ("1.01", "2.00", "1.00", "10.00")]
    assert row["_silver_at"] is not None and list(row)[:3] == ["order_id", "order_date", "due_date"]


def test_customers_without_a_person_have_an_empty_name(spark, rows):
    customer = spark.createDataFrame(
        [(1, 10, None, 1), (2, None, 5, 1), (3, 99, None, 2), (4, 11, None, 2)],
        "CustomerID int, PersonID int, StoreID int, TerritoryID int",
    )
    person = spark.createDataFrame(
        [(10, "Ada", "Byron", 1), (11, None, "Solo", 0)], "BusinessEntityID int, FirstName string, LastName string, EmailPromotion int"
    )
    got = rows(clean.silver_customers(customer, person), "customer_id", "full_name", "customer_type", "email_promo")
    assert got == [(1, "Ada Byron", "Individual", 1), (2, "", "Tienda", None), (3, "", "Individual", None), (4, "Solo", "Individual", 0)]


def test_a_missing_subcategory_takes_the_category_along(spark, rows):
    product = spark.createDataFrame(
        [(1, "a", "A", None, 1.005, 2.0, None, None, 7), (2, "b", "B", "red", 1.0, 2.0, "L", 1.5, None), (3, "c", "C", None, 1.0, 2.0, None, None, 8)],
        "ProductID int, Name string, ProductNumber string, Color string, StandardCost double, ListPrice double, Size string,"
        " Weight double, ProductSubcategoryID int",
    )
    sub = spark.createDataFrame([(7, 1, "road"), (8, 9, "trail")], "ProductSubcategoryID int, ProductCategoryID int, Name string")
    cat = spark.createDataFrame([(1, "bikes")], "ProductCategoryID int, Name string")
    got = rows(clean.silver_products(product, sub, cat), "product_id", "subcategory", "category", "size", "weight")
    assert got == [(1, "road", "bikes", None, None), (2, None, None, "L", 1.5), (3, "trail", None, None, None)]


def test_territory_mart_keeps_the_group_without_a_territory(spark, rows):
    o = orders(spark, (1, True, 1, 1, "10.00"), (2, True, 1, 1, "20.01"), (3, False, 2, None, "5.00"), (4, None, 3, 9, "6.00"))
    t = spark.createDataFrame([(1, "North", "NO", "Europe"), (2, "Empty", "XX", "Europe")], TERRITORIES)
    got = marts.gold_sales_by_territory(o, t).collect()
    assert [tuple(r)[:7] for r in got] == [
        (1, "North", "NO", "Europe", 2, 1, Decimal("30.01")),
        (9, None, None, None, 1, 1, Decimal("6.00")),
        (None, None, None, None, 1, 1, Decimal("5.00")),
    ]
    assert got[0]["avg_ticket"] == Decimal("15.01")  # 15.005 rounded half up


def test_repeated_dimension_rows_count_as_in_a_plain_join(spark, rows):
    o = orders(spark, (1, True, 1, 1, "10.00"), (2, True, 2, 1, "20.00"))
    t = spark.createDataFrame([(1, "North", "NO", "E"), (1, "North", "NO", "E"), (1, "Nord", "NO", "E")], TERRITORIES)
    got = rows(marts.gold_sales_by_territory(o, t), "territory", "total_orders", "unique_customers", "total_revenue", "avg_ticket")
    assert got == [("Nord", 2, 2, Decimal("30.00"), Decimal("15.00")), ("North", 4, 2, Decimal("60.00"), Decimal("15.00"))]


def test_online_share_is_null_without_any_known_channel(spark):
    row = marts.gold_sales_by_period(orders(spark, (1, None, 1, 1, "1.00"), (2, None, 1, 1, "2.00"))).first()
    assert (row["year"], row["quarter"], row["month"]) == (2024, 2, 5)
    assert (row["online_orders"], row["store_orders"], row["pct_online"]) == (0, 0, None)
    mixed = orders(spark, (1, True, 1, 1, "1.00"), (2, False, 1, 1, "2.00"), (3, True, 1, 1, "2.00"), (4, None, 1, 1, "2.00"))
    assert marts.gold_sales_by_period(mixed).first()["pct_online"] == 66.67


def lines(spark):
    data = [(1, 1, 2, "20.00", "10.00", "0.10"), (2, 1, 1, "9.99", "9.99", "0.00"), (3, 2, 5, "50.00", "10.00", "0.05"), (4, 9, 1, "1.00", "1.00", "0.00")]
    return spark.createDataFrame([(i, p, q, *map(Decimal, rest)) for i, p, q, *rest in data], LINES)


def products(spark):
    return spark.createDataFrame([(1, "one", "c", "s"), (2, "two", "c", "s"), (3, "three", "c", "t")], PRODUCTS)


def test_category_mart(spark, rows):
    got = marts.gold_sales_by_category(lines(spark), products(spark)).collect()
    assert [tuple(r)[:5] for r in got] == [("c", "s", 3, 8, Decimal("79.99")), (None, None, 1, 1, Decimal("1.00"))]
    assert (got[0]["avg_price"], got[0]["avg_discount"]) == (Decimal("10.00"), Decimal("0.0500"))


def test_product_ranking_is_whole_unless_a_number_is_given(spark):
    full = marts.gold_product_ranking(lines(spark), products(spark)).collect()
    assert [r["product_id"] for r in full] == [2, 1, 9]
    assert full[1]["est_margin"] == Decimal("11.99")  # 29.99 - 3 * 10.00 * 0.6, the price rounded from 9.995
    assert len(marts.gold_product_ranking(lines(spark), products(spark), n=2).collect()) == 2


def test_marts_accept_doubles(spark):
    o = orders(spark, (1, True, 1, 1, "10.00"))
    o = o.withColumn("total", o["total"].cast("double"))
    t = spark.createDataFrame([(1, "North", "NO", "E")], TERRITORIES)
    assert marts.gold_sales_by_territory(o, t).first()["avg_ticket"] == 10.0


def test_period_mart_is_ordered(spark):
    made = [orders(spark, (1, True, 1, 1, "1.00")).withColumn("order_date", F.lit(d).cast("timestamp")) for d in ("2024-11-02", "2023-02-01", "2024-01-05", "2023-12-31")]
    got = marts.gold_sales_by_period(reduce(lambda a, b: a.unionByName(b), made)).collect()
    assert [(r["year"], r["month"]) for r in got] == [(2023, 2), (2023, 12), (2024, 1), (2024, 11)]
