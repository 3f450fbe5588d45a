"""Relational operators over athletes' histories."""
