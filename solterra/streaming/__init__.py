"""solterra.streaming."""
