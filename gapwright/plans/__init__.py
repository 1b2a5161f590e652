"""Composed experiments and reports."""
