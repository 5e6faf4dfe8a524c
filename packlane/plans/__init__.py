"""Whole queries over a corpus: list, inspect, validate, extract, create, repack, report."""
