"""Training-data operators: deduplication, tagging, scoring, packing, media."""
