"""Streaming twins of the island queries. They have no counterpart to match; batch results are the reference."""
