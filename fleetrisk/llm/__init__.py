"""Operators of a training-data pipeline: cleaning, near duplicates, mixing and sharding."""
