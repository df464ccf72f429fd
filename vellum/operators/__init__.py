"""Relational operators of the content site: policies, single-row reads, changes, checks."""
