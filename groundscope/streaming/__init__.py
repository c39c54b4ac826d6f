"""Incremental capture of arriving predictions."""
