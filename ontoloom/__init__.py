"""Concept matching and data processing expressed as Spark DataFrame plans."""
