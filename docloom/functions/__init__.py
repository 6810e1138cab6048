"""Functions of the document library."""
