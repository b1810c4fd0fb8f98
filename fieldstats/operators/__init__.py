"""Analyses, recipes, roles and chart data."""
