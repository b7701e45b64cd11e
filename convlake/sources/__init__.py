"""Readers and writers with explicit schemas, and provenance of what they read and write."""
