"""Readers, writers, catalog access and the shared scratch folder."""
