"""Operators for training-data pipelines: tokens, near-duplicates, quality, secrets, licences, mixing."""
