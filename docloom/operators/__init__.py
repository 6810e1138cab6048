"""Operators of the document library."""
