"""Structured Streaming forms of the monitors; each has a batch form on the same expressions."""
