"""Readers, payload shaping, feeds, ledgers, and the mapping from the sample tables to market tables."""
