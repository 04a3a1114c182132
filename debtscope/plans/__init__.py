"""End-to-end reports built from the operators."""
