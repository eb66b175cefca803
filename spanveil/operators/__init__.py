"""Operators over tables with a text column."""
