"""Training-data operators: decontamination, mixing, token output, near-dedup and the like."""
