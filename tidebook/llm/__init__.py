"""Operators for large training corpora: one module per operator, ``queries`` registers them."""
