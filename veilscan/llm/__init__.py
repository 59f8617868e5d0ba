"""Operators for preparing training text: filters, near-duplicate removal, decontamination, mixing, sharding, counts."""
