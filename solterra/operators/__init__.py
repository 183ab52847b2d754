"""solterra.operators."""
