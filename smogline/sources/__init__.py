"""Readers, nested-record flattening and writers."""
