"""Plumbline: drawing, specification and corpus analytics expressed as Spark DataFrames."""
