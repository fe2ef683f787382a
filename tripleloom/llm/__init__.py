"""Training-data operators: deduplication, packing, tokenizing, scoring, search and media."""
