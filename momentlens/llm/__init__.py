"""Training-data operators: token counts, scoring, near-duplicates, packing, privacy and quality."""
