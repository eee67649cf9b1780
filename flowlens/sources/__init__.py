"""Readers, writers and projections."""
