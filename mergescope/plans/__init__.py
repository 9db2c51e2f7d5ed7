"""Composite jobs built from functions and operators."""
