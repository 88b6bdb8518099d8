"""Operators for preparing training text: filtering, duplicates, mixing, fingerprints, personal data, tokens, models."""
