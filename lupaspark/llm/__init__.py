"""Operators for preparing training data: near-duplicates, scoring, filtering, tokenizing, archives."""
