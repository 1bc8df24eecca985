"""Indicator rules, the catalogue of summary tables, and the combined reports."""
