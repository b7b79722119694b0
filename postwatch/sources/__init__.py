"""Scans. Schemas are always given, never inferred."""
