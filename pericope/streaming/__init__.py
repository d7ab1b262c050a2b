"""The reference has no streams; ingest.py keeps the index of a growing folder of translations up to date with Structured Streaming."""
