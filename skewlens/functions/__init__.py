"""Column expressions: keyed hashes, vector arithmetic, losses and verdicts."""
