"""Operators over proteins, codon tables, structures and run records."""
