"""Operators of a training-data pipeline: filtering, deduplication, mixing,
tagging and token output. Nothing else in the library imports this package."""
