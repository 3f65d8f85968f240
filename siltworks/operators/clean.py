"""Raw (bronze) tables to conformed (silver) tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from siltworks.functions.columns import conform, rounded, stamped
from siltworks.functions.text import full_name
from siltworks.operators.skew import hot_lookup, lookup, skew_join
from siltworks.sources.scratch import cut

STAMP = "_silver_at"

# Column names of the source tables and the names they get here.
ORDERS = {
    "SalesOrderID": "order_id",
    "OrderDate": "order_date",
    "DueDate": "due_date",
    "ShipDate": "ship_date",
    "Status": "status",
    "OnlineOrderFlag": "is_online",
    "CustomerID": "customer_id",
    "SalesPersonID": "salesperson_id",
    "TerritoryID": "territory_id",
    "SubTotal": "subtotal",
    "TaxAmt": "tax",
    "Freight": "freight",
    "TotalDue": "total",
}
ORDER_LINES = {
    "SalesOrderDetailID": "line_id",
    "SalesOrderID": "order_id",
    "ProductID": "product_id",
    "OrderQty": "quantity",
    "UnitPrice": "unit_price",
    "UnitPriceDiscount": "discount",
    "LineTotal": "line_total",
}
CUSTOMERS = {
    "CustomerID": "customer_id",
    "PersonID": "person_id",
    "StoreID": "store_id",
    "TerritoryID": "territory_id",
}
PERSONS = {
    "BusinessEntityID": "person_id",
    "FirstName": "first_name",
    "LastName": "last_name",
    "EmailPromotion": "email_promo",
}
TERRITORIES = {
    "TerritoryID": "territory_id",
    "Name": "territory",
    "CountryRegionCode": "country_code",
    "Group": "region_group",
}
PRODUCTS = {
    "ProductID": "product_id",
    "Name": "product",
    "ProductNumber": "product_code",
    "Color": "color",
    "StandardCost": "standard_cost",
    "ListPrice": "list_price",
    "Size": "size",
    "Weight": "weight",
    "ProductSubcategoryID": "subcategory_id",
}
SUBCATEGORIES = {
    "ProductSubcategoryID": "subcategory_id",
    "ProductCategoryID": "category_id",
    "Name": "subcategory",
}
CATEGORIES = {"ProductCategoryID": "category_id", "Name": "category"}
ADDRESSES = {
    "AddressID": "address_id",
    "AddressLine1": "address",
    "City": "city",
    "StateProvinceID": "state_id",
    "PostalCode": "postal_code",
}


def silver_orders(header: DataFrame) -> DataFrame:
    """Order headers with money rounded to cents."""
    return stamped(rounded(conform(header, ORDERS), 2, "subtotal", "tax", "freight", "total"), STAMP)


def silver_order_lines(detail: DataFrame) -> DataFrame:
    """Order lines; the discount is a rate and stays as it is."""
    return stamped(rounded(conform(detail, ORDER_LINES), 2, "unit_price", "line_total"), STAMP)


def silver_customers(customer: DataFrame, person: DataFrame) -> DataFrame:
    """Customers with the name of their person, if any, and their kind.

    Both inputs grow together, so the join is skew-safe; store customers carry no person.
    """
    joined = skew_join(conform(customer, CUSTOMERS), conform(person, PERSONS), "person_id", "left")
    kind = F.when(F.col("store_id").isNotNull(), "Tienda").otherwise("Individual")
    named = joined.select(
        "customer_id",
        "person_id",
        "store_id",
        "territory_id",
        full_name(F.col("first_name"), F.col("last_name")).alias("full_name"),
        "email_promo",
        kind.alias("customer_type"),
    )
    return stamped(named, STAMP)


def silver_territories(territory: DataFrame) -> DataFrame:
    return stamped(conform(territory, TERRITORIES), STAMP)


def silver_products(product: DataFrame, subcategory: DataFrame, category: DataFrame) -> DataFrame:
    """Products with subcategory and category names.

    The two small tables are joined first, so products meet one dimension instead of two; a
    product whose subcategory is missing has no category either. The dimension is stored and measured; a subcategory with
    a large part of all products meets a broadcast of its own row. Starts a job.
    """
    kinds = lookup(conform(subcategory, SUBCATEGORIES), conform(category, CATEGORIES), "category_id")
    kinds = cut(kinds.drop("category_id"), "product-kinds")
    named = hot_lookup(conform(product, PRODUCTS), kinds, "subcategory_id").drop("subcategory_id")
    return stamped(rounded(named, 2, "standard_cost", "list_price"), STAMP)


def silver_addresses(address: DataFrame) -> DataFrame:
    return stamped(conform(address, ADDRESSES), STAMP)
