"""Checked reads and staged writes."""
