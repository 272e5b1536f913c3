"""Training-data operators: ten large-scale document operators and their queries."""
