"""End-to-end flows built from the operators, and the queries over the given tables."""
