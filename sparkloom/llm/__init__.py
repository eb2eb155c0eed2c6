"""Training-data operators: near-duplicates, media containers, mixing, quality, token counts, toxicity, URL rules, sub-word encoding, sharding, HTML."""
