"""Chromatography analytics expressed as Spark jobs."""
