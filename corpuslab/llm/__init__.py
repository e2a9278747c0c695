"""Operators for training data: damaged encodings, copies, near-duplicates, splits, samples, token ids, leakage, shared spans."""
