"""Boxloom operators."""
