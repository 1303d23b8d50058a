"""Operators of a training-data pipeline: text rules, tokens, near copies, mixtures, shards, pages."""
