"""Boxloom functions."""
