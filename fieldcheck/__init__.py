"""Preparation and certification of scientific observation data as Spark jobs."""
