"""Readers, writers and the bindings of the standard tables."""
