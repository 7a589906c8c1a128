"""The tables behind each dashboard page, from filtered item rows and the stored feature table.

``stored_items`` writes the wide item rows once; every page table then scans only the columns it needs.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from bazaarlens.functions.storage import materialise
from bazaarlens.models import explain, score
from bazaarlens.operators import kpi, product, profile, regional, sales
from bazaarlens.operators.base import order_items_wide
from bazaarlens.operators.filters import Filters, all_options, apply_filters, date_bounds
from bazaarlens.sources.tables import CommerceTables


def stored_items(tables: CommerceTables) -> DataFrame:
    return materialise(order_items_wide(tables), "items")


def filter_choices(items: DataFrame) -> dict[str, DataFrame]:
    return {"dates": date_bounds(items), "options": all_options(items)}


def executive_page(items: DataFrame, features: DataFrame, filters: Filters = Filters()) -> dict[str, DataFrame]:
    items = apply_filters(items, filters)
    return {
        "kpis": kpi.executive_kpis(items, features),
        "headlines": kpi.display_kpis(items, features),
        "monthly_revenue": sales.monthly_revenue(items),
        "monthly_orders": sales.monthly_orders(items),
        "top_categories": product.top_category_revenue(items, 10),
        "churn_split": profile.churn_split(features),
    }


def sales_page(items: DataFrame, filters: Filters = Filters()) -> dict[str, DataFrame]:
    items = apply_filters(items, filters)
    return {
        "monthly": sales.monthly_growth(items),
        "category_trend": sales.category_trend(items),
        "top_products": sales.top_products(items),
        "bottom_products": sales.bottom_products(items),
        "monthly_aov": sales.monthly_aov(items),
        "payments": sales.payment_breakdown(items),
    }


def product_page(items: DataFrame, filters: Filters = Filters()) -> dict[str, DataFrame]:
    items = apply_filters(items, filters)
    return {
        "categories": product.category_performance(items),
        "top_by_revenue": product.top_categories(items, "revenue", 15),
        "top_by_orders": product.top_categories(items, "orders", 15),
        "revenue_orders_review": product.top_categories(items, "revenue", 30),
        "best_rated": product.best_rated_categories(items),
    }


def regional_page(items: DataFrame, filters: Filters = Filters()) -> dict[str, DataFrame]:
    items = apply_filters(items, filters)
    rankings = {
        f"by_{measure}": regional.state_ranking(items, measure)
        for measure in ("revenue", "orders", "avg_delivery", "pct_delayed")
    }
    return {"states": regional.state_performance(items), **rankings, "top_cities": regional.top_cities(items)}


def customer_page(features: DataFrame) -> dict[str, DataFrame]:
    return {
        "spend_histogram": profile.spend_histogram(features, 60),
        "common_order_counts": profile.common_order_counts(features),
        "buyer_types": profile.buyer_types(features),
        "summary": profile.customer_summary(features),
        "review_distribution": profile.review_distribution(features),
        "review_by_churn": profile.mean_by_churn(features, "avg_review_score"),
        "delay_by_churn": profile.mean_by_churn(features, "pct_delayed"),
        "sample": profile.spend_orders_sample(features),
        "correlations": profile.correlation_matrix(features, profile.SHORT_CORRELATION_COLUMNS),
    }


def churn_page(features: DataFrame, model: PipelineModel) -> dict[str, DataFrame]:
    """Risk and reasons for every customer of the table, not one at a time."""
    # the dearest job of all pages, for two of its tables
    attributions = materialise(explain.attributions(model, features), "attributions")
    return {
        "choices": profile.customer_choices(features),
        "profiles": profile.profile_text(features),
        "risk": score.add_risk(score.predict_churn(model, features)),
        "reasons_shown": explain.top_attributions(attributions, 12),
        "reasons_kept": explain.top_attributions(attributions, 8),
    }


def insights_page(items: DataFrame, features: DataFrame, filters: Filters = Filters()) -> dict[str, DataFrame]:
    return {"context": kpi.business_context(apply_filters(items, filters), features)}


def printed_report(
    items: DataFrame, features: DataFrame, metrics: DataFrame, filters: Filters = Filters()
) -> dict[str, DataFrame]:
    items = apply_filters(items, filters)
    return {
        "kpis": kpi.report_kpis(items, features),
        "months": kpi.best_and_worst_month(items),
        "top_categories": product.ranked_categories(items, 10),
        "top_states": regional.top_states(items),
        "model": metrics,
    }
