"""Readers, writers and durable intermediate results."""
