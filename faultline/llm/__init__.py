"""Training-data operators: deduplication, tokens, language, decontamination, toxicity, privacy, search, archives."""
