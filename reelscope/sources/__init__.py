"""Scans, landed payloads and sinks."""
