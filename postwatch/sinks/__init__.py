"""Writes. A run owns one directory per table, so writing it again replaces only its own rows."""
