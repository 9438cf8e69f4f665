"""Relational operators over the deck, slide and shape tables."""
