"""Boxloom plans."""
