"""Structured Streaming over files of compressed data."""
