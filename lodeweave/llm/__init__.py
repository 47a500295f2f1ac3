"""Operators for training data: splitting, near duplicates, incremental dedup, vector neighbours, token ids, packing, languages."""
