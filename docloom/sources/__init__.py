"""Sources of the document library."""
