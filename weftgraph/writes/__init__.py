"""Writes: each takes a graph and gives another, or raises and changes nothing."""
