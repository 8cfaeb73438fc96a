"""Training-data operators: scoring, mixing, tokenising, near copies, scans, search."""
