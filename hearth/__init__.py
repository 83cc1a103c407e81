"""Hearth: listings analytics and corpus preparation as Spark jobs."""
