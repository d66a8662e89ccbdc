"""Operators of a training-data pipeline, each a composition of Spark jobs."""
