"""Spanish names of tables and columns, for lakes whose readers expect them."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Table names.
TABLES = {
    "orders": "pedidos",
    "order_lines": "detalle_pedidos",
    "customers": "clientes",
    "territories": "territorios",
    "products": "productos",
    "addresses": "direcciones",
    "sales_by_territory": "ventas_por_territorio",
    "sales_by_category": "ventas_por_categoria",
    "sales_by_period": "ventas_por_periodo",
    "product_ranking": "top_productos",
}

# Column names; columns not listed are the same in both languages.
COLUMNS = {
    "order_id": "pedido_id",
    "order_date": "fecha_pedido",
    "due_date": "fecha_entrega",
    "ship_date": "fecha_envio",
    "status": "estado",
    "is_online": "es_online",
    "customer_id": "cliente_id",
    "salesperson_id": "vendedor_id",
    "territory_id": "territorio_id",
    "tax": "impuesto",
    "freight": "flete",
    "line_id": "detalle_id",
    "product_id": "producto_id",
    "quantity": "cantidad",
    "unit_price": "precio_unitario",
    "discount": "descuento",
    "line_total": "total_linea",
    "person_id": "persona_id",
    "store_id": "tienda_id",
    "full_name": "nombre_completo",
    "email_promo": "acepta_email_promo",
    "customer_type": "tipo_cliente",
    "territory": "territorio",
    "country_code": "pais_codigo",
    "region_group": "grupo",
    "product": "producto",
    "product_code": "codigo_producto",
    "standard_cost": "costo_estandar",
    "list_price": "precio_lista",
    "size": "tamano",
    "weight": "peso",
    "subcategory": "subcategoria",
    "category": "categoria",
    "address_id": "direccion_id",
    "address": "direccion",
    "city": "ciudad",
    "state_id": "provincia_id",
    "postal_code": "codigo_postal",
    "total_orders": "total_pedidos",
    "unique_customers": "clientes_unicos",
    "total_revenue": "ingresos_totales",
    "avg_ticket": "ticket_promedio",
    "total_freight": "flete_total",
    "lines_sold": "lineas_vendidas",
    "units_sold": "unidades_vendidas",
    "avg_price": "precio_promedio",
    "avg_discount": "descuento_promedio",
    "year": "anio",
    "quarter": "trimestre",
    "month": "mes",
    "online_orders": "pedidos_online",
    "store_orders": "pedidos_tienda",
    "times_sold": "veces_vendido",
    "total_units": "unidades_totales",
    "est_margin": "margen_estimado",
}


def to_spanish(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(COLUMNS)


def to_english(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({spanish: english for english, spanish in COLUMNS.items()})
