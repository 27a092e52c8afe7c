"""Storage of collections, and other sources of points."""
