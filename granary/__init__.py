"""Granary: corpus curation, retrieval and evaluation operators as PySpark DataFrame plans."""
