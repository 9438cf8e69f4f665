"""Decks as they arrive."""
