"""solterra.plans."""
