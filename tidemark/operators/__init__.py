"""Keyed-collection operators as DataFrame plans, and the delta algebra that maintains them."""
