"""Training-data operators: filters, near-duplicates, archives, search, tokens, language, mixing, toxicity."""
