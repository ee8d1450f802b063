"""Operators for building training data: quality, near and exact repeats, tokens, packing, links."""
