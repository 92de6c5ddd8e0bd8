"""Training-data operators: sharding, archives, near-duplicates, privacy, decontamination, packing."""
