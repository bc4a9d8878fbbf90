"""Operators for training data: deduplication, decontamination, tokens, language, WARC, rules."""
