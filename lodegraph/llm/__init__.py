"""Operators over texts for language-model data: syntax, tokenisation, packing, abusive content."""
