"""Readers, writers, catalogue and sampling."""
