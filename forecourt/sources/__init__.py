"""Readers, writers and column resolvers."""
