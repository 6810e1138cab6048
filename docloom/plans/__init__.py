"""Plans of the document library."""
