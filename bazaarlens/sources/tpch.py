"""Shape the order-processing star schema (orders, lineitem, part, ...) as the commerce source tables.

``FIXTURES.md`` gives the same definitions as SQL; both engines of the correctness check use them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bazaarlens.sources.tables import CommerceTables


# Schemas of the input files. Stating them saves a job per file that would only read its footer.
SCHEMAS = {
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
    "l_shipdate TIMESTAMP_NTZ",
}


def tables_from_tpch(spark: SparkSession, folder: str) -> CommerceTables:
    def read(name: str) -> DataFrame:
        return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")

    return CommerceTables(
        customers=lambda: _customers(read("customer"), read("nation")),
        sellers=lambda: _sellers(read("supplier"), read("nation")),
        product_category_translation=lambda: _translation(read("part")),
        products=lambda: _products(read("part")),
        orders=lambda: _orders(read("orders")),
        order_items=lambda: _order_items(read("lineitem")),
        payments=lambda: _payments(read("lineitem")),
        reviews=lambda: _reviews(read("lineitem")),
    )


def _customers(customer: DataFrame, nation: DataFrame) -> DataFrame:
    # nation has 25 rows; Catalyst broadcasts it by its file size.
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_custkey").alias("customer_unique_id"),
        F.lpad(F.col("c_nationkey").cast("string"), 5, "0").alias("customer_zip_code_prefix"),
        F.lower(F.concat_ws(" ", "c_mktsegment", "n_name")).alias("customer_city"),
        F.col("n_name").alias("customer_state"),
    )


def _sellers(supplier: DataFrame, nation: DataFrame) -> DataFrame:
    return supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("seller_id"),
        F.lpad(F.col("s_nationkey").cast("string"), 5, "0").alias("seller_zip_code_prefix"),
        F.lower(F.col("n_name")).alias("seller_city"),
        F.col("n_name").alias("seller_state"),
    )


def _category(part: DataFrame):
    return F.lower(F.concat_ws("_", part["p_type"], part["p_brand"]))


def _products(part: DataFrame) -> DataFrame:
    return part.select(
        F.col("p_partkey").alias("product_id"),
        F.when(F.col("p_partkey") % 37 != 0, _category(part)).alias("product_category_name"),
    )


def _translation(part: DataFrame) -> DataFrame:
    return (
        part.filter(F.col("p_type") != "PROMO")
        .select(
            _category(part).alias("product_category_name"),
            F.concat(F.lit("en_"), _category(part)).alias("product_category_name_english"),
        )
        .distinct()
    )


def _orders(orders: DataFrame) -> DataFrame:
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    return orders.select(
        key.alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.when(F.col("o_orderstatus") == "F", "delivered")
        .when(F.col("o_orderstatus") == "O", "shipped")
        .otherwise("processing")
        .alias("order_status"),
        F.timestamp_add("SECOND", (key * 7919 % 86400).cast("int"), day).alias("order_purchase_timestamp"),
        F.when(key % 97 != 0, F.timestamp_add("HOUR", (key * 31 % 720 + 1).cast("int"), day)).alias(
            "order_delivered_customer_date"
        ),
        F.timestamp_add("DAY", (key % 16 + 10).cast("int"), day).alias("order_estimated_delivery_date"),
    )


def _order_items(lineitem: DataFrame) -> DataFrame:
    price = F.col("l_extendedprice")
    return lineitem.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        price.cast("decimal(18,2)").alias("price"),
        F.round(price.cast("decimal(12,2)") * F.col("l_tax").cast("decimal(4,2)"), 2)
        .cast("decimal(18,2)")
        .alias("freight_value"),
    )


def _payments(lineitem: DataFrame) -> DataFrame:
    # Only a filter on the number keeps this window alive, and `= 1` then trims each order before the shuffle.
    number = F.row_number().over(
        Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    )
    flags = F.concat("l_returnflag", "l_linestatus")
    paid = (
        F.col("l_extendedprice").cast("decimal(12,2)")
        * (1 - F.col("l_discount")).cast("decimal(4,2)")
        * (1 + F.col("l_tax")).cast("decimal(4,2)")
    )
    return lineitem.select(
        F.col("l_orderkey").alias("order_id"),
        number.alias("payment_sequential"),
        F.when(flags == "AF", "boleto")
        .when(flags == "NF", "voucher")
        .when(flags == "RO", "debit_card")
        .otherwise("credit_card")
        .alias("payment_type"),
        (F.col("l_quantity").cast("int") % 10 + 1).alias("payment_installments"),
        F.round(paid, 2).cast("decimal(18,2)").alias("payment_value"),
    )


def _reviews(lineitem: DataFrame) -> DataFrame:
    return lineitem.filter(F.col("l_linenumber") == 1).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("review_id"),
        F.col("l_orderkey").alias("order_id"),
        (F.col("l_quantity").cast("int") % 5 + 1).alias("review_score"),
    )
