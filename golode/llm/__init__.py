"""Training-data operators: dedup, packing, tokens, search, extraction, scoring, archives."""
