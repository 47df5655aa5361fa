"""Operators for large training-text corpora; see the modules of this package."""
