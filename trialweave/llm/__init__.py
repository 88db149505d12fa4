"""Operators for preparing language-model training data at scale.

Each module holds one operator with a general interface; ``queries`` registers
the thin queries over the standard tables.  Nothing outside this package
imports it.
"""
