"""Operators for preparing training corpora at scale. Nothing outside this package imports it."""
