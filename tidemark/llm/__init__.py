"""Operators of a training-data pipeline: dedup, packing, tokens, quality, language, HTML."""
