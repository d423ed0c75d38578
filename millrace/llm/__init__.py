"""Training-data operators: deduplication, language, privacy, mixing, decontamination, sharding."""
