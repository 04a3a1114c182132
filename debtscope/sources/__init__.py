"""Readers that produce the ``files`` relation."""
