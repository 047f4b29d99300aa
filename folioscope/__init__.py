"""Corpus-scale document structuring on Spark."""
