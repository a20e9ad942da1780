"""strandworks: window-based haplotype analytics expressed as Spark plans."""
