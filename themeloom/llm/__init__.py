"""Operators that prepare training text: deduplication, decontamination, scoring, packing, output."""
