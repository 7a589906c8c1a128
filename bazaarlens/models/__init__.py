"""Churn models on the feature table with Spark ML: preparation, training, evaluation, scoring, attribution."""
