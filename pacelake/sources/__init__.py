"""Readers, writers and decoded device messages."""
