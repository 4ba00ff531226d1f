"""Readers and writers for feeds, payloads and tables."""
