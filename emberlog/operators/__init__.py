"""Filters, projections, sorts, limits and aggregations over rows, as DataFrame expressions."""
