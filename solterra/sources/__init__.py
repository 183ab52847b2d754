"""solterra.sources."""
