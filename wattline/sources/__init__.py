"""Readers: raw archives and files to tidy tables with fixed schemas."""
