"""Queries made of the operators, with their SQL."""
