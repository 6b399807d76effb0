"""Boxloom sources."""
