"""Training-data operators: dedup, scoring, decontamination, mixing, extraction and token output."""
