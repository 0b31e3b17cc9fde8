"""Readers, writers and file-catalog queries."""
