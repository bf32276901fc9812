"""Training-data operators: near-duplicates, privacy, formatting, packing, mixing."""
