"""Dependency-health analytics as Spark jobs: scan, diet, licences, text and graph."""

__version__ = "0.1.0"
