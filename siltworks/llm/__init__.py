"""Operators of a training-data pipeline: dedup, chat, tokens, leaks, toxicity, language, personal data."""
