"""Landed raw files to DataFrames of one row per record."""
