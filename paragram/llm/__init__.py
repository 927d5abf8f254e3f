"""Operators of a training-data pipeline: tokens, fingerprints, packing, dedup, quality, toxicity."""
