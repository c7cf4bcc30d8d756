"""Column functions: spans with offsets, identifiers, text splicing."""
