"""Column expressions for nucleotides, codons and structures."""
