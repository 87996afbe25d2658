"""Operators for large training-text corpora; nothing outside this folder imports it."""
