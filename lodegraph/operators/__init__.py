"""Queries and rules over graph tables, as DataFrame operators."""
