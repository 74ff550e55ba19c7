"""Corpus-preparation operators for training data. Self-contained: nothing else in the library imports this package."""
