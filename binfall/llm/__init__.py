"""Training-data operators: near-dedup, sanitising, mixing, scanning, scoring, extraction and tokenising."""
