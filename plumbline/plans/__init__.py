"""Queries over the star schema."""
