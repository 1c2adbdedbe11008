"""Whole plans: the single-pass audit, its reports, and the means to scale them."""
