"""Readers for proteins, codon tables, run records and key=value text."""
