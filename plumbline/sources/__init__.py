"""Readers of drawings and specification pages."""
