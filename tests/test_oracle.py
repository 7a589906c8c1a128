"""Registered queries against DuckDB on the smallest tables. ``python tests/oracle.py`` checks all of them at sf0.01."""

from __future__ import annotations

import oracle
import pytest

from bazaarlens.registry import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
CHECKED = (
    "s02_stored_orders s03_row_counts s04_duplicate_keys s05_orphan_counts s06_missing_mandatory b01_order_items_wide b09_feature_input "
    "c03_first_line_per_seller c09_cleaning_audit c09_clean_items c09_clean_dirty_rows c11_membership_filter "
    "c12_filter_options q01_monthly_orders q02_monthly_revenue q03_avg_order_value q04_orders_by_state "
    "q05_payment_distribution q06_repeat_customers q07_revenue_by_category q08_avg_review_score q09_top_customers "
    "q10_top_products k01_executive_kpis k02_report_kpis k03_business_context k04_best_and_worst_month k05_number_text "
    "a02_monthly_orders_by_sketch a03_monthly_growth a04_category_trend a06_bottom_products a07_monthly_aov a08_payment_breakdown a09_top_categories "
    "a14_best_rated_categories a15_states_by_sketch a16_states_by_orders a17_top_cities a18_top_states a20_payment_order_counts "
    "f14_preferred_payment f21_customer_features f21_customer_features_of_items e01_dataset_summary "
    "e04_review_distribution e05_spend_histogram_60 e08_churn_by_state e10_short_correlation_matrix e14_customer_sample "
    "e16_customer_profiles m02_imputed_numbers m04_category_codes m04_codes_by_join m05_scaled_inputs m06_stratified_split "
    "m11_binary_metrics m12_roc_curve m16_classification_report m19_linear_attributions m21_strongest_attributions"
).split()


@pytest.fixture(scope="module")
def connection():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, connection, name):
    assert oracle.difference(spark, connection, FOLDER, name) is None


def test_only_fitted_models_and_maps_lack_sql():
    without = sorted(set(QUERIES) - set(ORACLE))
    assert all(name.startswith("m") or name == "k03_business_context_row" for name in without)
