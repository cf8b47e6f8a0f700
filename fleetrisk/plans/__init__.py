"""Whole pipelines over one portfolio, fleet or training set."""
