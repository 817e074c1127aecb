"""Readers, stores and the catalogue."""
