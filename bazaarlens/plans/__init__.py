"""Whole jobs composed of the operators: the batch run and the dashboard pages."""
