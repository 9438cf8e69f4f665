"""Exceptions of the library."""


class DeckError(Exception):
    """Base of all of them."""


class ParseError(DeckError):
    """A deck is missing or cannot be read at all."""


class InstallationError(DeckError):
    """An optional dependency is needed and not installed."""


class DescribeError(DeckError):
    """A provider could not describe an image or reconstruct a slide."""
