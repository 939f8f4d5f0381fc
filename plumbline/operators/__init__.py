"""Spatial joins, netlists and text retrieval on DataFrames."""
