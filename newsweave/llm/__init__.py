"""Operators of a training-data pipeline: archives, near copies, URL rules, toxicity, quality, tokens, page text, leaks, scoring."""
