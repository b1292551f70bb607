"""Training-data pipeline operators: scoring, deduplication, decontamination, tokenising and formatting of text tables."""
