"""Readers and writers for keyed text, change logs, graphs and documents."""
