"""Structured Streaming jobs over landed tick and message files."""
