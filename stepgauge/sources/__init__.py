"""Readers, parsers, settings and writers."""
