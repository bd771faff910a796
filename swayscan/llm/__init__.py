"""Operators for preparing large text collections: search, copies, mixing, tokens, archives, classifiers."""
