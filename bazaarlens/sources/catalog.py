"""Declared shape of the nine source tables: columns, keys, references and mandatory columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

_TYPES: dict[str, T.DataType] = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    # Sums of decimals do not depend on row order, so repeated runs give equal reports.
    "money": T.DecimalType(18, 2),
    # Wall-clock times without a zone, so day and month boundaries do not move with the session zone.
    "time": T.TimestampNTZType(),
}


@dataclass(frozen=True)
class Reference:
    """``columns`` of this table must exist as the key of ``parent``."""

    columns: tuple[str, ...]
    parent: str


@dataclass(frozen=True)
class TableSpec:
    name: str
    columns: dict[str, str]
    key: tuple[str, ...] = ()
    optional: frozenset[str] = frozenset()
    references: tuple[Reference, ...] = ()
    csv_file: str = ""
    multi_line: bool = False

    @property
    def schema(self) -> T.StructType:
        return T.StructType(
            [T.StructField(c, _TYPES[t], c in self.optional) for c, t in self.columns.items()]
        )

    @property
    def mandatory(self) -> list[str]:
        return [c for c in self.columns if c not in self.optional]

    def columns_of(self, kind: str) -> list[str]:
        return [c for c, t in self.columns.items() if t == kind]


# Table and column names of the input data.
_SPECS = (
    TableSpec(
        name="customers",
        columns={
            "customer_id": "string",
            "customer_unique_id": "string",
            "customer_zip_code_prefix": "string",
            "customer_city": "string",
            "customer_state": "string",
        },
        key=("customer_id",),
        csv_file="*customers*.csv",
    ),
    TableSpec(
        name="geolocation",
        columns={
            "geolocation_zip_code_prefix": "string",
            "geolocation_lat": "double",
            "geolocation_lng": "double",
            "geolocation_city": "string",
            "geolocation_state": "string",
        },
        csv_file="*geolocation*.csv",
    ),
    TableSpec(
        name="sellers",
        columns={
            "seller_id": "string",
            "seller_zip_code_prefix": "string",
            "seller_city": "string",
            "seller_state": "string",
        },
        key=("seller_id",),
        csv_file="*sellers*.csv",
    ),
    TableSpec(
        name="product_category_translation",
        columns={"product_category_name": "string", "product_category_name_english": "string"},
        key=("product_category_name",),
        csv_file="*product_category*.csv",
    ),
    TableSpec(
        name="products",
        columns={
            "product_id": "string",
            "product_category_name": "string",
            "product_name_length": "int",
            "product_description_length": "int",
            "product_photos_qty": "int",
            "product_weight_g": "double",
            "product_length_cm": "double",
            "product_height_cm": "double",
            "product_width_cm": "double",
        },
        key=("product_id",),
        optional=frozenset(
            {
                "product_category_name",
                "product_name_length",
                "product_description_length",
                "product_photos_qty",
                "product_weight_g",
                "product_length_cm",
                "product_height_cm",
                "product_width_cm",
            }
        ),
        references=(Reference(("product_category_name",), "product_category_translation"),),
        csv_file="*products*.csv",
    ),
    TableSpec(
        name="orders",
        columns={
            "order_id": "string",
            "customer_id": "string",
            "order_status": "string",
            "order_purchase_timestamp": "time",
            "order_approved_at": "time",
            "order_delivered_carrier_date": "time",
            "order_delivered_customer_date": "time",
            "order_estimated_delivery_date": "time",
        },
        key=("order_id",),
        optional=frozenset(
            {
                "order_purchase_timestamp",
                "order_approved_at",
                "order_delivered_carrier_date",
                "order_delivered_customer_date",
                "order_estimated_delivery_date",
            }
        ),
        references=(Reference(("customer_id",), "customers"),),
        csv_file="*orders*.csv",
    ),
    TableSpec(
        name="order_items",
        columns={
            "order_id": "string",
            "order_item_id": "int",
            "product_id": "string",
            "seller_id": "string",
            "shipping_limit_date": "time",
            "price": "money",
            "freight_value": "money",
        },
        key=("order_id", "order_item_id"),
        optional=frozenset({"shipping_limit_date"}),
        references=(
            Reference(("order_id",), "orders"),
            Reference(("product_id",), "products"),
            Reference(("seller_id",), "sellers"),
        ),
        csv_file="*order_items*.csv",
    ),
    TableSpec(
        name="payments",
        columns={
            "order_id": "string",
            "payment_sequential": "int",
            "payment_type": "string",
            "payment_installments": "int",
            "payment_value": "money",
        },
        key=("order_id", "payment_sequential"),
        references=(Reference(("order_id",), "orders"),),
        csv_file="*payments*.csv",
    ),
    TableSpec(
        name="reviews",
        columns={
            "review_id": "string",
            "order_id": "string",
            "review_score": "int",
            "review_comment_title": "string",
            "review_comment_message": "string",
            "review_creation_date": "time",
            "review_answer_timestamp": "time",
        },
        key=("review_id", "order_id"),
        optional=frozenset(
            {
                "review_comment_title",
                "review_comment_message",
                "review_creation_date",
                "review_answer_timestamp",
            }
        ),
        references=(Reference(("order_id",), "orders"),),
        csv_file="*reviews*.csv",
        multi_line=True,
    ),
)

CATALOG: dict[str, TableSpec] = {spec.name: spec for spec in _SPECS}
