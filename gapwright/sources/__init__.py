"""Readers: LAS text, tables, coordinates, stored datasets and prediction stores."""
