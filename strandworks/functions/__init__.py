"""Column functions: packed alleles, clamps, log-space arithmetic."""
