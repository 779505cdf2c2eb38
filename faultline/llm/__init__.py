"""Operators of a training-data pipeline: near duplicates, search, quality, secrets, archives, chat, mixing, tokens."""
