"""Household-survey indicators on Spark: recodes, design-based estimates, breakdowns, reports."""
