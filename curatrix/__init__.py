"""Labelled-data curation, splitting and evaluation as Spark jobs."""
