"""Streams of quote rows."""
