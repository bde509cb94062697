"""Operators that prepare training text: cleaning, deduplication, decontamination, mixing, formatting."""
