"""Training-data pipeline operators: sharding, filtering, decontamination, mixing, deduplication, extraction."""
