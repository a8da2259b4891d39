"""Operators for preparing training text: copies, filters, scores, mixes and packed token ids."""
