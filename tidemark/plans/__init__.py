"""Lazily built operator graphs, run in full or brought up to date from changes."""
