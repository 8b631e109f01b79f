"""Column functions: text, paths, vectors, labels and report strings."""
