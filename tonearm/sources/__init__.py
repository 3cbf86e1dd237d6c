"""Readers, writers and the mapping of the supplied tables to the domain."""
