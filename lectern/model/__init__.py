"""Calls of language models as a function of columns, with a deterministic stand-in."""
