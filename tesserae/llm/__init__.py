"""Operators for large text and memory corpora; nothing outside this subpackage imports it."""
