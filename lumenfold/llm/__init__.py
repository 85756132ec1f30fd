"""Training-data operators: PII, near and exact dedup, sharding, tokenising, mixing, URL and toxicity filters."""
