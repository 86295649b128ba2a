"""Spark jobs for news and document signals: classification, entities, rollups, trends, reports."""

__version__ = "0.1.0"
