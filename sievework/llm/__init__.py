"""Operators for preparing training data from text: filtering, mixing, encoding, search."""
