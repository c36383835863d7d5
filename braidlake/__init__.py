"""braidlake: sequence graphs, haplotype paths and aligned reads as Spark tables."""
