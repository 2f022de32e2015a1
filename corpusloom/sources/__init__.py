"""Readers, writers and intermediate storage."""
