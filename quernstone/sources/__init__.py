"""Readers with explicit schemas, validation, and writers."""
