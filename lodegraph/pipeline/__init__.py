"""Operators for data that arrives as snapshots, copies, references and nested records."""
