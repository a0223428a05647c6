"""Streams and resumable stages."""
