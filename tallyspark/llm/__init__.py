"""Operators of a training-data pipeline, one module each; see README for the methods."""
