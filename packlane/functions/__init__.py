"""Byte machines and pure rules, free of Spark: scan, parse, write, fold, classify."""
