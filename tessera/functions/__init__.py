"""Column and grouped functions: ranks, correlations, vectors and tail probabilities."""
