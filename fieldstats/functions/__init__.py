"""Column expressions: coercion, calendar and binning."""
