"""Stateless ingestion of new packages."""
