"""Keyed state machines, as folds over sorted rows and as streaming queries."""
