"""Readers of deck files, pixels and renders; Python runs only here."""
