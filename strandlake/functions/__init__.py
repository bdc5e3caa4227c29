"""Column functions: sequence, coordinates, scores, variants."""
