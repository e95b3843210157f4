"""Inputs and outputs: parquet tables, sheets, HTML pages, CSV export."""
