"""Readers and writers: explicit schemas, no inference."""
