"""Operators for building large training corpora.  Nothing outside imports this folder."""
