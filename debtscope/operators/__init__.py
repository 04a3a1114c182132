"""Per-file and per-corpus operators."""
