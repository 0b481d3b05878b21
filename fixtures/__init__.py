"""Test documents and bookkeeping tables derived from the given tables."""
