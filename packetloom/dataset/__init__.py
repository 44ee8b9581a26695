"""Portable datasets: acquisition, extraction, validation and aggregation of a day of captures."""
