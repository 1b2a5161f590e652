"""Reusable column functions and skew-safe building blocks."""
