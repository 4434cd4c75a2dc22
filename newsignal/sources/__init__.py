"""Readers for landed feed payloads and the three tables."""
