"""Operators that prepare text, vectors and web records for training language models."""
