"""Composite verbs built from the operators."""
