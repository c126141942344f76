"""Temporal property-graph analytics on Spark: graph, journal, provenance and text operators as DataFrame plans."""

__version__ = "0.1.0"
