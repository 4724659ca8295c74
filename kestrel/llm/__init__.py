"""Operators for preparing training data: search, counting, de-duplication, filtering, mixing, packing."""
