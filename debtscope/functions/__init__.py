"""Column helpers: patterns, text, labels and scores."""
