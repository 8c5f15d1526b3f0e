"""Readers and writers of landed payloads and stored tables."""
