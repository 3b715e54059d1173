"""Spark jobs that turn document text into a searchable, citable knowledge graph."""
