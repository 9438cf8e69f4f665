"""Queries over the driver's tables, viewed as decks, and their SQL."""
