"""Session settings and lineage control."""
