"""Small hand-made source tables."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

from bazaarlens.sources.catalog import CATALOG
from bazaarlens.sources.tables import CommerceTables


def at(text: str | None) -> datetime | None:
    return None if text is None else datetime.fromisoformat(text)


def table(spark, name: str, rows: list[dict]):
    schema = CATALOG[name].schema
    values = []
    for row in rows:
        full = []
        for field in schema.fields:
            value = row.get(field.name, "-" if field.name not in CATALOG[name].optional else None)
            kind = CATALOG[name].columns[field.name]
            if value is not None:
                if kind == "money":
                    value = Decimal(str(value))
                elif kind == "time" and isinstance(value, str):
                    value = at(value)
            full.append(value)
        values.append(tuple(full))
    # Nullable, so that tests can break the contract.
    for field in schema.fields:
        field.nullable = True
    return spark.createDataFrame(values, schema)


def tables(spark, **rows) -> CommerceTables:
    filled = {name: rows.get(name, []) for name in CATALOG}
    return CommerceTables(**{name: table(spark, name, given) for name, given in filled.items()})


def customer(key: str, person: str | None = None, city="c", state="s") -> dict:
    return {
        "customer_id": key,
        "customer_unique_id": person or key,
        "customer_zip_code_prefix": "01000",
        "customer_city": city,
        "customer_state": state,
    }


def order(key: str, customer_id: str, bought: str | None, delivered=None, due="2020-12-31", status="delivered") -> dict:
    return {
        "order_id": key,
        "customer_id": customer_id,
        "order_status": status,
        "order_purchase_timestamp": bought,
        "order_delivered_customer_date": delivered,
        "order_estimated_delivery_date": due,
    }


def item(order_id: str, number=1, product="p", seller="v", price=10, freight=1) -> dict:
    return {
        "order_id": order_id,
        "order_item_id": number,
        "product_id": product,
        "seller_id": seller,
        "price": price,
        "freight_value": freight,
    }


def payment(order_id: str, kind="boleto", value=10, number=1) -> dict:
    return {
        "order_id": order_id,
        "payment_sequential": number,
        "payment_type": kind,
        "payment_installments": 1,
        "payment_value": value,
    }


def review(order_id: str, score: int, key="r") -> dict:
    return {"review_id": key, "order_id": order_id, "review_score": score}


def as_dicts(df) -> list[dict]:
    return [row.asDict(recursive=True) for row in df.collect()]


def by(df, key: str) -> dict:
    return {row[key]: row.asDict(recursive=True) for row in df.collect()}
