"""deckloom: slide decks, and tables viewed as decks, turned into Markdown on Spark.

Names are loaded when they are first used, so that executors that need one
module do not import them all.
"""

from importlib import import_module

_HOMES = {
    "deckloom.api": ("ConvertOptions", "ValidationResult", "convert", "convert_files", "to_markdown", "validate_markdown"),
    "deckloom.errors": ("DeckError", "DescribeError", "InstallationError", "ParseError"),
    "deckloom.functions.text": ("MASK_TOKEN", "MaskingOptions"),
    "deckloom.providers": ("ImageDescriber", "get_describer"),
}
_HOME = {name: home for home, names in _HOMES.items() for name in names}

__all__ = sorted(_HOME)


def __getattr__(name: str):
    if name in _HOME:
        return getattr(import_module(_HOME[name]), name)
    raise AttributeError(name)
