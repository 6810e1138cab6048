"""Streaming of the document library."""
