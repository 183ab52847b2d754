"""solterra.functions."""
