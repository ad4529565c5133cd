"""Column expressions: names, digests, replies."""
