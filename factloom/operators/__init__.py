"""Operators over mutation logs and fact tables."""
